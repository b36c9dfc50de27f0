"""Edge cases and brute-force comparisons of the training-data operators."""

import random

import numpy as np
import pytest
from revlens.llm import decontaminate, html_extract, line_dedup, mixing, near_dedup, order_minhash, quality, toxicity

DOCS = "doc_id long, text string, source string, n_lines string"
ODD = [(1, None, None, "x"), (2, "", "a", None), (None, "one", "a", None), (4, "one", "a", None), (4, "one", "a", None), (5, "w " * 3000, "b", None)]


@pytest.mark.parametrize("limit", [0, 200_000])
def test_lines(spark, limit):
    rows = [(i, f" Shared {i}\nMENU\nown {i}\n\n", "a", None) for i in range(4)] + ODD
    out = {(r.doc_id, r.kept_text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS), min_docs=4, broadcast_keys=limit).collect()}
    assert (3, " Shared 3\nown 3\n\n") in out and (2, "") in out and (1, "") in out


def test_mixing_odd_rows_and_rerun(spark):
    df = spark.createDataFrame(ODD, DOCS)
    a, b = (sorted(map(str, mixing.mix(df).collect())) for _ in range(2))
    assert len(a) == 6 and a == b
    assert mixing.mix(df.limit(0)).count() == 0


def test_near_duplicates_agree_with_all_pairs(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(5)]
    docs = []
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = "x"
        docs.append((i, " ".join(w)))
    sets = [{tuple(t.split()[j : j + 4]) for j in range(57)} for _, t in docs]
    root = list(range(60))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=4).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: find(i) for i in range(60)}
    assert near_dedup.near_duplicates(spark.createDataFrame(ODD, DOCS)).count() == 6


def test_crowded_buckets_keep_every_link(spark, monkeypatch):
    """One bucket of texts that mostly stay under the threshold, over several blocks, against all pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(200):
        w = list(base)
        for p in rng.sample(range(100), rng.choice((2, 3, 4, 5, 6))):
            w[p] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    sets = [{tuple(t.split()[j : j + 4]) for j in range(97)} for _, t in docs]
    root = list(range(200))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(200):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=4).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: find(i) for i in range(200)}


def test_leaks_with_a_substitution(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    docs = [(1, f"before {item} after"), (2, "before " + item.replace("theta", "other")), (3, "nothing here"), (4, None)]
    out = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, None)], "item_id long, text string")).collect()
    assert {r.doc_id: r["items"] for r in out} == {1: [7], 2: [7], 3: [], 4: []}


def test_minimum_cut_by_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        n = rng.randrange(1, 9)
        odds = [round(rng.uniform(-4, 4), 1) for _ in range(n)]
        edges = [(a, b, round(rng.uniform(0, 3), 1), round(rng.uniform(0, 3), 1)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(k, n=n, odds=odds, edges=edges):
            ends = sum(max(-odds[i], 0) if k[i] else max(odds[i], 0) for i in range(n))
            return ends + sum(c if k[a] and not k[b] else d if k[b] and not k[a] else 0 for a, b, c, d in edges)

        assert cost(html_extract.minimum_cut(odds, edges)) == pytest.approx(min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n)))


def test_pages_of_odd_markup(spark):
    import time

    text = html_extract.main_text
    assert text("<article><p class='share-price'>The price.</p><p class=\"a>Hello there</p><p>x</p><div class='post-comments'><p>A reader's comment, long enough to look like text.</p></div></article>") == "The price.\nHello there\nx"
    assert text("<div class=comments><article><p>A long comment by some reader who goes on for long.</p></article></div><article><header><h1>T</h1></header><p><a href=1>one link</a></p></article>") == "T\none link"
    assert text("<title>t</title><noscript>n</noscript><svg><text>s</text></svg><article>a<script>if (1<2) x</script>b<!-- <p>c --></article") == "ab"
    assert [text(x) for x in (None, "", "<", "<p", "a < b &lt; &#x63;", "<p>four words of text<!-- x")] == ["", "", "", "", "a < b < c", "four words of text"]
    page = "<article>" + "".join(f"<p>{'word ' * (i % 13)}x</p><div class=ad><p>buy {i}</p></div>" for i in range(5000)) + "</article>"
    began = time.process_time()
    assert text(page).count("\n") == 4999 and time.process_time() - began < 4
    graph = html_extract.Graph(page, html_extract.Model([]))
    keep = html_extract.minimum_cut(graph.odds, graph.edges)
    assert any(keep[i] != (graph.odds[i] > 0) for i in graph.nodes)  # the edges decide
    pages = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, None), (2, "v", "", "y")], "page_id long, url string, html string, n_chars string")
    out = html_extract.extract(pages).collect()
    assert [r.n_chars for r in out] == [len(text(page))] * 2 + [0, 0] and out[2].text == ""
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_main_text():
    page = "<body><nav><a href=x>Menu</a></nav><div class='ad'>Buy</div><article><h1>T</h1><p>one &amp;\n two<br>three<p>four</article><form>f</form><div class=comments><p>hm</div><footer>x</footer>"
    assert html_extract.main_text(page) == "T\none & two three\nfour" and html_extract.main_text(None) == ""


def test_fingerprints(spark):
    words = decontaminate.Words()
    t = "a b c d e f g h i j"
    assert order_minhash.fingerprint(t, words) == order_minhash.fingerprint(t, words)
    assert order_minhash.likeness(order_minhash.fingerprint(t, words), order_minhash.fingerprint("k l m n", words)) < 0.1
    assert order_minhash.fingerprints(spark.createDataFrame(ODD, DOCS)).count() == 6


def test_network_gradient():
    net, rng = toxicity.Net(np.zeros(2), 2), np.random.default_rng(2)
    x = rng.normal(size=(3, toxicity.WINDOW, toxicity.INPUTS))
    real = np.ones((3, toxicity.WINDOW))
    real[0, 9:] = 0
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    out, kept = net.forward(x, real, True)
    g, dx = net.backward(x, real, kept, np.ones(3))

    def slope(a, at):
        a[at] += 1e-5
        up = net.forward(x, real).sum()
        a[at] -= 2e-5
        down = net.forward(x, real).sum()
        a[at] += 1e-5
        return (up - down) / 2e-5

    for k, v in net.p.items():
        at = tuple(0 for _ in v.shape)
        assert g[k][at] == pytest.approx(slope(v, at), rel=1e-3, abs=1e-6), k
    for at in ((0, 3, 1), (0, 12, 1), (2, 15, 8)):
        assert dx[at] == pytest.approx(slope(x, at), rel=1e-3, abs=1e-6)
    assert dx[0, 12, 1] == 0


def test_all_windows_score_as_a_plain_loop_does(monkeypatch):
    """A text of several parts, a short, an empty and a repeated one: each scores as its highest window, looked at one by one."""
    monkeypatch.setattr(toxicity, "CHUNK", 24)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["good", "vile,", "Plain", "the", "of", "..."]) for _ in range(n)) for n in (100, 3, 0, 16, 17)]
    texts.append(texts[0])
    vocabulary = toxicity.Vocabulary(texts * 3, np.arange(18) % 2)
    net = toxicity.Net(vocabulary.odds, vocabulary.n_grams + 1)
    got = toxicity.Scorer(vocabulary, net).top(texts)

    def one(words):
        x, real = np.zeros((1, toxicity.WINDOW, toxicity.INPUTS), np.float32), np.zeros((1, toxicity.WINDOW), np.float32)
        for i, w in enumerate(words):
            x[0, i], real[0, i] = net.inputs(*vocabulary.rows([toxicity._word(w)]))[0], 1
        return net.forward(x, real)[0]

    for text, score in zip(texts, got, strict=True):
        w = text.split()
        assert score == pytest.approx(max(one(w[i : i + toxicity.WINDOW]) for i in range(max(1, len(w) - toxicity.WINDOW + 1))), abs=1e-4)
    assert got[0] == got[-1]


def test_toxic_words_are_learned_wherever_they_stand(spark):
    rng = random.Random(3)
    fill = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    rows = [(i, " ".join(fill(rng.randrange(60)) + (["vile", "scum"] if i % 2 else []) + fill(rng.randrange(60)))) for i in range(120)]
    rows += [(500, " ".join(fill(6000) + ["vile", "scum"] + fill(20))), (501, " ".join(fill(6000))), (502, None), (503, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(3, 0), (None, 1), (5, None)], "doc_id long, label int")
    out = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string"), labels).collect()}
    assert sum((out[i] > 0.5) == bool(i % 2) for i in range(100, 120)) >= 18 and out[500] > out[501] and out[502] == out[503]


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_scores_of_odd_rows(spark, score):
    labels = spark.createDataFrame([(4, 1), (5, 0), (2, None)], "doc_id long, label int")
    out = [r.score for r in score(spark.createDataFrame(ODD, DOCS), labels).collect()]
    assert len(out) == 6 and all(0 <= s <= 1 for s in out)
    assert score(spark.createDataFrame([], DOCS), labels).count() == 0


def test_half_edited_is_nearer_than_another_text():
    words, rng = decontaminate.Words(), random.Random(3)
    a, b = (" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(2))
    half = a[: len(a) // 2] + b[: len(a) // 2]
    f = [order_minhash.fingerprint(t, words) for t in (a, half, b)]
    assert order_minhash.likeness(f[0], f[1]) > order_minhash.likeness(f[0], f[2])


def test_repeats_agree_with_all_windows(spark):
    from collections import Counter

    from revlens.llm import suffix_dedup

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = word(260)
    docs = [(i, word(rng.randrange(300)) + shared[rng.randrange(40) :] + word(rng.randrange(100))) for i in range(25)]
    docs += [(30, docs[0][1]), (31, "z" * 500), (32, None), (33, ""), (33, "")]
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    want = []
    for i, b in raw:
        gone = set()
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone |= set(range(k, k + 200))
        want.append((i, len(b), len(gone), bytes(c for k, c in enumerate(b) if k not in gone)))
    out = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in out) == sorted(want)


def test_crowded_groups_split_by_context(spark, monkeypatch):
    """One passage in many contexts, its ends cut at many places, copies among them: bytes removed as by counting all windows."""
    import hashlib
    from collections import Counter

    from revlens.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "CROWD", 3)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = word(700)
    docs = [(i, word(rng.randrange(400)) + passage[rng.randrange(9) : 690 + rng.randrange(10)] + word(rng.randrange(400))) for i in range(40)]
    docs += [(100 + i, t) for i, t in docs[:8]] + [(200, None), (201, "é" * 300), (202, "aab" * 200), (203, passage[:205] + "!" + passage[205:])]
    count = Counter(raw[i : i + 200] for _, t in docs for raw in [(t or "").encode()] for i in range(len(raw) - 199))
    want = {}
    for d, t in docs:
        raw, gone = (t or "").encode(), set()
        for i in range(len(raw) - 199):
            if count[raw[i : i + 200]] > 1:
                gone.update(range(i, i + 200))
        want[d] = (len(gone), hashlib.sha256(bytes(c for i, c in enumerate(raw) if i not in gone)).hexdigest())
    out = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in out} == want


def test_shards_merge_as_one():
    from revlens.llm.suffix_dedup import repeated_starts

    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(12)]
    one, many = (repeated_starts(texts, [1] * 12, 6, size) for size in (1 << 20, 50))
    assert all((a == b).all() for a, b in zip(one, many, strict=True))


def test_language_of_odd_pages(spark):
    from revlens.llm import language

    pages = [(1, "http://a.example.com/fr/1", "<html lang=fr><p>le la de"), (2, None, None), (3, "", ""), (1, "http://a.example.com/fr/1", "<html lang=fr><p>le la de")]
    known = spark.createDataFrame([("le la de que", "fr"), ("the of and that", "en")], "text string, lang string")
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = language.identify(df, known).collect()
    assert len(out) == 4 and {r.lang for r in out if r.page_id == 1} == {"fr"}
    assert language.identify(df, known.limit(0)).count() == 4


def test_leaks_agree_with_all_diagonals(spark):
    rng = random.Random(6)
    items, docs = [], []
    for n in [*range(1, 31), 40, 60] * 6:
        x = [f"w{rng.randrange(900)}" for _ in range(n)]
        y = list(x)
        for k in rng.sample(range(n), n // 5):
            y[k] = f"v{rng.randrange(900)}"
        items.append((len(items), " ".join(x)))
        docs.append((len(docs), " ".join([f"u{rng.randrange(900)}" for _ in range(rng.randrange(9))] + y + ["u"] * rng.randrange(3))))
    want = {}
    for d, t in docs:
        x = t.split()
        for i, s in items:
            y = s.split()
            if any(5 * sum(x[k + j] == w for j, w in enumerate(y) if 0 <= k + j < len(x)) >= 4 * len(y) for k in range(-len(y), len(x))):
                want.setdefault(d, set()).add(i)
    out = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(d in want[d] for d, _ in docs) and all(want[r.doc_id] <= set(r["items"]) for r in out)


def test_leaks_of_edited_parts(spark):
    y = [f"w{i}" for i in range(59)]
    short = [f"s{i}" for i in range(15)]
    texts = [y[:20] + ["put", "in"] + y[20:], y[:29] + y[30:], ["a"] * 9 + y[9:49] + ["b"] * 30, short[:7] + ["in"] + short[7:], short[:7] + short[8:], y[:10] + ["z"] * 40, short[:5] + ["in"] * 9 + short[5:]]
    out = decontaminate.find(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(y)), (8, " ".join(short))], "item_id long, text string")).collect()
    assert {r.doc_id: r["items"] for r in out} == {0: [7], 1: [7], 2: [7], 3: [8], 4: [8], 5: [], 6: []}


def test_leaks_agree_with_edit_distances():
    def holds(y, x):
        least = min(len(y), decontaminate.PART)
        for start in range(len(y) - least + 1):
            row = [0] * (len(x) + 1)
            for n, w in enumerate(y[start:], 1):
                new = [n]
                for j, v in enumerate(x):
                    new.append(min(row[j] + (v != w), row[j + 1] + 1, new[j] + 1))
                row = new
                if n >= least and 5 * min(row) <= n:
                    return True
        return False

    rng, words, seen = random.Random(8), decontaminate.Words(), set()
    for _ in range(1500):
        y = [f"w{rng.randrange(rng.choice([4, 40]))}" for _ in range(rng.randrange(1, 34))]
        x = []
        for w in y:
            k = rng.random()
            x += [w] if k > 0.24 else [[f"w{rng.randrange(40)}"], [], [w, "in"]][int(k / 0.08)]
        x = x[rng.randrange(4) :] + [f"w{rng.randrange(40)}" for _ in range(rng.randrange(5))]
        texts, index = decontaminate._index([(0, " ".join(y))], 0.8)
        got = decontaminate.leaks([words.of("a b c"), words.of(" ".join(x))], texts, index, 0.8)
        assert got == [set(), {0} if holds(y, x) else set()], (y, x)
        seen.add((len(y) < decontaminate.PART, bool(got[1])))
    assert len(seen) == 4 and decontaminate.leaks([], texts, index, 0.8) == []


def test_every_language_is_known(spark):
    from revlens.llm import language

    langs = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(70)]
    labelled = [(f"{x}qx{x}z {x}j{x} w{x}{x}k", x) for x in langs for _ in range(1 + (x != langs[-1]))]
    pages = [(i, f"http://h{i}.com/", f"<html lang={x}>{x}qx{x}z {x}j{x} w{x}{x}k") for i, x in enumerate(langs)]
    out = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(labelled, "text string, lang string"), rows=2).collect()
    assert {r.page_id: r.lang for r in out} == dict(enumerate(langs))


def test_copies_take_one_place_in_the_language_sample(spark):
    from revlens.llm import language

    texts = [f"text {chr(97 + i)}{chr(98 + i)}{chr(99 + i)}" for i in range(8)]
    once, many = (language.text_model(spark.createDataFrame([(t, "en") for t in texts for _ in range(n)], "text string, lang string"), rows=5) for n in (1, 9))
    assert once[0] == many[0] == ["en"] and np.allclose(once[1], many[1])


def test_rows_of_one_id_and_repeated_rows(spark):
    """Different texts of one id are nodes of their own; of each component one id's one text stays."""
    text = " ".join(f"w{i}" for i in range(40))
    near = text.replace("w39", "other")
    rows = [(1, text), (1, "quite another text of six words"), (2, near), (3, near), (3, near), (None, text), (4, None), (5, " \n"), (6, "one two")]
    rows += [(7, "quite another text of six words."), (1, text.replace(" ", "  ")), (8, "One  TWO")]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for r in by[2] + by[3]} == {1} and not any(r.kept for r in by[2] + by[3])
    assert by[None][0].component_id is None and by[None][0].kept and by[4][0].kept and by[5][0].n_shingles == 0
    assert by[8][0].component_id == 6 and by[6][0].kept
    stay = [r for r in out if r.stays]
    assert sorted((r.doc_id or 0, r.n_shingles) for r in stay) == [(0, 36), (1, 2), (1, 36), (4, 0), (5, 0), (6, 1), (7, 2)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_edited_texts_and_fingerprints_by_brute_force(spark, parts):
    import hashlib

    rng = random.Random(parts)
    rows = [(i * 7 % 100, " ".join(f"é{rng.randrange(50)}" for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(None, f"no id {i}") for i in range(12)] + [(None, None), (7, "same id"), (7, "same id"), (7, None), (200, "x " * 30000)]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, part int, key int")
    signed = {r.text: r.h for r in df.selectExpr("text", "xxhash64(coalesce(text, '')) AS h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -r[0] if r[0] is not None else -signed[r[1]], r[1] or ""))
    words, want = decontaminate.Words(), []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        f, fe, fn = (order_minhash.fingerprint(x, words) for x in (t, edited, nxt))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, fe, order_minhash.likeness(f, fe), order_minhash.likeness(f, fn)))
    got = [tuple(r) for r in order_minhash.fingerprints(df, parts=parts).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert order_minhash.fingerprints(df.limit(0)).count() == 0


def test_fingerprint_by_its_definition():
    """Each function: number k-mers by occurrence, take the two smallest by the function's hash, in text order."""
    words = decontaminate.Words()
    mix = order_minhash._mixed
    text = "a b a c b a d"
    a = np.random.default_rng(23).integers(1, 1 << 63, order_minhash.HASHES, dtype=np.uint64) | np.uint64(1)
    seen, grams = {}, []
    for w in text.split():
        nth = seen.get(w, 0)
        seen[w] = nth + 1
        with np.errstate(over="ignore"):
            grams.append(mix(mix(np.array([words[w]], np.uint64)) + np.uint64(nth) * order_minhash._MIX[1])[0])
    out = ""
    with np.errstate(over="ignore"):
        for f in a:
            v = [g * f for g in grams]
            v = [x ^ (x >> np.uint64(32)) for x in v]
            low = sorted(sorted(range(len(v)), key=lambda i: v[i])[:2])
            h = np.zeros(1, np.uint64)
            for i in low:
                h = mix(h ^ v[i])
            out += f"{int(h[0]) >> 48:04x}"
    assert order_minhash.fingerprint(text, words) == out


def test_equal_rows_at_the_edge_are_counted(spark):
    """30 equal rows in each of two sources; and a draw by brute force: ranks, certain copies, the edge on the nearer side."""
    rows = [(1, "w " * 10, s) for s in ("a", "b") for _ in range(30)] + [(2, "w " * 10, "c")] * 40 + [(3, None, None), (3, "", "c")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_times=3.0, share=0.5).collect()
    taken, target = {}, {}
    for r in out:
        taken[r.source_size, r.target] = taken.get((r.source_size, r.target), 0) + r.taken
        target[r.source_size, r.target] = r.target
    assert len(out) == len(rows) and all(abs(taken[k] - target[k]) <= 5 for k in taken)
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 30), rng.choice("abcd")) for i in range(200)] + [(999, "w " * 7, "d")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashed = df.selectExpr("doc_id", "text", "source", "xxhash64(doc_id, 17, xxhash64(text)) AS h").collect()
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abcd"}
    got = mixing.mix(df)
    goal = {r.source_size: r.target for r in got.collect()}
    want = {}
    for s in "abcd":
        times = goal[size[s]] / size[s]
        whole, part = int(times), times - int(times)
        draw = []
        for r in hashed:
            if r.source == s:
                u = ((r.h & ((1 << 64) - 1)) >> 11) + 0.5
                u /= float(1 << 53)
                odds = u / (1 - u) / (part / (1 - part) if 0 < part < 1 else 1)
                draw.append((int(odds / (1 + odds) * float(1 << 48)), u, r.doc_id, len(r.text.split())))
        left = goal[size[s]] - whole * size[s]
        for _, _, i, n in sorted(draw):
            take = left > 0 and (n <= left or n - left <= left)
            left = left - n if take else 0
            want.setdefault((s, i), []).append(n * (whole + take))
    have = {}
    for r in got.collect():
        s = next(x for x in "abcd" if size[x] == r.source_size)
        have.setdefault((s, r.doc_id), []).append(r.taken)
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
