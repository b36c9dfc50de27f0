"""The filter audit, the repair of conversations and the licence scan against plain loops over small tables with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations, product

import pytest
from pyspark.sql import functions as F
from revlens.llm import conversation_repair, filter_audit, license_scan

WS = "\t\n\x0b\x0c\r "
DOC = "doc_id long, text string, source string"


def _documents():
    rng = random.Random(5)
    words = ["a", "B", "é", "#x", "one", "TWO", "three", "\U0001f600"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 250, 2000]))) for _ in range(25)]
    texts += [" ".join(f"w{i}" for i in range(n)) for n in (199, 200, 5000)] + ["x" * 70 + "y", "x" * 70 + "z", "x" * 2000 + "y", "x" * 2000 + "z", "", None, " \t\n "]
    rows = [(i * 7 % 101, rng.choice(texts), rng.choice(["s", "s", "s", "t", None, ""])) for i in range(120)]
    return rows + [(None, texts[0], "s"), (None, None, None), (3, texts[0], "s"), (3, texts[0], "s"), (3, texts[1], "s"), (500, "only here", "alone")]


LABELS = [(7, 1, 0), (7, 0, 1), (14, 1, None), (21, None, 1), (None, 1, 1), (3, 1, 1), (500, 0, 0), (999, 1, 1)]


def _failing(rows):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, part in rows:
        text = text or ""
        words = [w for w in re.split(f"[{WS}]+", text) if w]
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        out.append((i, part or "", fails + "E" * (i is not None and i > first[text])))
    return out


def _audited(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    fails, out = _failing(rows), {}
    removed_by = Counter()
    for part in {p for _, p, _ in fails}:
        for order in permutations("ABCDE"):
            left = [(i, f) for i, p, f in fails if p == part]
            every = left
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                counts = (len(left), len(gone), sum(x in f for _, f in every) - len(gone), sum(f == x for _, f in every), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                out[part, "".join(order), step] = counts
                removed_by[part, x] += len(gone)
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize(("bits", "most"), [(64, 200_000), (1, 200_000), (64, 0), (1, 0)])
def test_filter_audit(spark, bits, most):
    """Every order's counts; keys of one bit put different texts in one class, which only the whole texts tell apart."""
    rows = _documents()
    docs = spark.createDataFrame(rows, DOC).select("*", F.lit(1).alias("mask"), F.array(F.lit("x")).alias("k1"), F.lit("y").alias("part"))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(docs, labels, bits=bits, broadcast_classes=most).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out} == _audited(rows, LABELS)
    assert len(out) == 600 * 4


def test_filter_audit_marks_and_empty(spark):
    rows = _documents()
    marks = filter_audit.mark(spark.createDataFrame(rows, DOC)).collect()
    bit = {x: 1 << i for i, x in enumerate("ABCDE")}
    assert Counter((r.doc_id, r.part, r.mask) for r in marks) == Counter((i, p, sum(bit[x] for x in f)) for i, p, f in _failing(rows))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], DOC), labels).count() == 0
    assert {r.good_lost for r in filter_audit.audit(spark.createDataFrame(rows, DOC), labels).collect()} == {0}


TURN = "conv_id long, turn long, role string, text string"


def _conversations(n, most, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        size = rng.randint(1, most)
        turns = [rng.choice([None, k, k, k, k + 1]) for k in range(size)]
        rows += [(conv or None, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Hi.", "So?", "cut", "", " \n", None, "Yes! ", "a b.\t", "é…"])) for t in turns]
    return rows


def _initials_fit(s):
    return re.fullmatch(r"(s?(ua)+)?", s) is not None


def _repaired(rows):
    """All edits of few rows, the cheapest with the least audit."""
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(WS)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    gaps = [("", []), ("I", ["user:"]), ("I", ["assistant:"]), ("II", ["user:", "assistant:"]), ("II", ["assistant:", "user:"])]
    best = None
    choices = []
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        own = [("D", 4, [])]
        if fault not in ("b", "d"):
            extra = 3 if fault == "t" else 0
            own += [("K", extra, [f"{role}:{text}"]), ("R", 3 + extra, [f"user:{text}"]), ("R", 3 + extra, [f"assistant:{text}"])]
        choices += [gaps, own]
    for picked in product(*choices, gaps):
        audit = "".join(p[0] for p in picked)
        cost = sum(p[1] if isinstance(p[1], int) else 3 * len(p[0]) for p in picked)
        turns = [t for p in picked for t in p[-1]]
        if (best is None or (cost, audit) <= best[:2]) and _initials_fit("".join(t[0] if t[0] != ":" else "x" for t in turns)):
            assert best is None or (cost, audit) < best[:2] or turns == best[2]
            best = (cost, audit, turns)
    known = [t for has, t, _, _ in rows if has]
    missing = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (missing, faults.count("b"), faults.count("d"), faults.count("t"), illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


@pytest.mark.parametrize("chunk", [2, 3, 4096])
def test_repair_is_the_cheapest(spark, chunk):
    """Against all edits of short conversations; small chunks cut conversations in two."""
    rows = _conversations(60, 3, 1)
    frame = spark.createDataFrame(rows, TURN).select("*", F.lit(1).alias("fault"), F.lit("x").alias("conv"), F.lit(2).alias("audit"))
    out = conversation_repair.repair(frame, chunk=chunk).collect()
    want = {c: _repaired([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert {r.conv_id: tuple(r)[1:] for r in out} == want
    assert len(out) == len(want)


def test_repair_of_long_conversations(spark):
    """A conversation of many chunks comes out as in one; the texts are those of the hash."""
    rows = _conversations(6, 200, 2) + [(77, k, "user" if k % 2 else "assistant", f"t{k}.") for k in range(300)]
    frame = spark.createDataFrame(rows, TURN)
    whole = {r.conv_id: tuple(r) for r in conversation_repair.repair(frame, texts=True).collect()}
    cut = {r.conv_id: tuple(r) for r in conversation_repair.repair(frame, texts=True, chunk=7).collect()}
    assert whole == cut
    for r in whole.values():
        assert hashlib.sha256(r[9].encode()).hexdigest() == r[8]
    assert whole[77][6:8] == (6, "I" + "K" * 300 + "I")


def test_repair_of_odd_tables(spark):
    assert conversation_repair.repair(spark.createDataFrame([], TURN)).count() == 0
    long = "word " * 40_000 + "."
    rows = [(1, None, None, None), (2, 5, "user", long), (2, 6, "assistant", long), (2, 6, "assistant", long), (None, None, None, None)]
    out = {r.conv_id: r for r in conversation_repair.repair(spark.createDataFrame(rows, TURN)).collect()}
    assert (out[2].audit, out[2].cost, out[2].duplicate, out[2].gaps) == ("KKD", 4, 1, 0)
    assert (out[1].audit, out[1].blank, out[None].audit) == ("D", 1, "D")


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "a.b!c?") for c in range(30) for t in (None, 0, 1)] + [(None, 1, None, None)]
    got = Counter(map(tuple, conversation_repair.damage(spark.createDataFrame(rows, TURN)).collect()))
    want = Counter()
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if fate:
            want[c, t, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text] += 2 if fate == 3 else 1
    assert got == want


def _plain_scan(texts):
    known = license_scan.templates()
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    vocabulary = {w.decode() for t in known for w in t.words}
    idf = {w: math.log(1 + (len(texts) + 1) / (sum(w in s for s in split) + 1)) for w in vocabulary}
    out = []
    for words in split:
        base, labels, score = [], set(), 0.0
        for t in known:
            tw = [w.decode() for w in t.words]
            for b in range(-len(tw), len(words)):
                hit = [0 <= b + q < len(words) and words[b + q] == w for q, w in enumerate(tw)]
                if all(hit[q] for q in t.must):
                    share = round(sum(idf[w] for w, h in zip(tw, hit, strict=True) if h) / sum(idf[w] for w in tw), 6)
                    score = max(score, share)
                    labels |= {t.label} if share >= license_scan.SHARE else set()
                    base += [(b, t.label)] if t.bare else []
        first, last = (min(base)[0], max(base)[0]) if base else (None, None)
        out.append((len(words), len(base), first, last, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 6)))
    return out


NOTICES = [
    "Released under the MIT License.", "CC BY 4.0, cc-by; CC  BY", "mit mit license license", "apache\nlicense" * 3, None, "", "  ", "éapache license", "Apache LICENSE x apache license",
    "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal\n# in the Software without restriction",
    "Permission is hereby granted, free of charge, to any person getting a copy of this thing and associated papers, to deal in the Software without restriction",
    "redistribution and use in source and binary forms, with or without alteration, are permitted provided that the following conditions are met:", "source and binary forms following conditions are met",
    "SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: GPL", "under the terms of the gnu general public license", "public license gnu general public license", "gnu general public license " * 40, "license " * 500 + "mit",
    "this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "word " * 30_000 + "mit license",
]


def test_license_scan(spark):
    """Every place of every template, against a loop over all offsets; columns of clashing names change nothing."""
    rows = [(i, t) for i, t in enumerate(NOTICES)] + [(None, NOTICES[0]), (0, NOTICES[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = docs.select("*", *[F.array(F.lit("x")).alias(c) for c in ("labels", "score", "places", "n_words", "word", "n")])
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = Counter((i, *r) for (i, _), r in zip(rows, _plain_scan([t for _, t in rows]), strict=True))
    for frame in (docs, clash):
        out = license_scan.scan(frame)
        assert Counter(map(tuple, out.select(*names).collect())) == want
    assert license_scan.scan(docs.limit(0)).count() == 0
    by = {r.doc_id: r for r in license_scan.scan(docs.where("doc_id > 0")).collect()}
    assert by[9].labels == "mit" and by[9].base_labels == "" and by[12].labels == "" and by[19].labels == "cc-by-sa"
    assert [p.label for p in by[13].places] == ["apache"]
