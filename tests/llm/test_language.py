"""Language by fused evidence, against a plain reading of the same rule."""

import math
import random
import re

from revlens.llm import language


def _buckets(text):
    letters = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
    out = []
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        out.append((((ord(a) * 961 + ord(b) * 31 + ord(c)) * 0x9E3779B97F4A7C15) % 2**64) >> 50)
    return out


def _plain(pages, labelled):
    """(language, probability) of each page: text, declaration and suffix, then host over domain over all, each without the page itself."""
    langs = sorted({lang for t, lang in labelled if t is not None and lang is not None})
    model = []
    for lang in langs:
        table = [0.1] * language.BUCKETS
        for text in {t for t, x in labelled if x == lang and t is not None}:
            for b in _buckets(text):
                table[b] += 1
        total = sum(table)
        model.append([math.log(x / total) for x in table])
    n = len(langs)

    def votes(name, trust):
        if name not in langs:
            return [0.0] * n
        return [math.log(trust) if lang == name else math.log((1 - trust) / (n - 1)) for lang in langs]

    rows = []
    for url, html in pages:
        grams = _buckets(re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;", " ", html or ""))
        m = max(len(grams), 1)
        likely = [sum(t[b] for b in grams) * min(m, 30 + math.log(m)) / m for t in model]
        declared = re.search(r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]+)", html or "")
        host = re.match(r"\w+://([^/:?#]+)", url or "")
        host = host[1].lower() if host else ""
        part = re.match(r"\w+://[^/]+/([a-z]{2})(?:/|$)", url or "") or re.search(r"\.([a-z]{2})$", host)
        e = [a + b + c for a, b, c in zip(likely, votes(declared[1].lower() if declared else "", language.DECLARED), votes(part[1] if part else "", language.SUFFIX), strict=True)]
        soft = [math.exp(x - max(e)) for x in e]
        domain = re.search(r"([^.]+\.[^.]+)$", host)
        rows.append((host, domain[1] if domain else "", e, [x / sum(soft) for x in soft]))
    add = lambda pick: [sum(q[i] for *key, _, q in rows if pick(key)) for i in range(n)]
    every = add(lambda _: True)
    base = [(x + 1) / (sum(every) + n) for x in every]
    out = []
    for host, domain, e, q in rows:
        # A host belongs to one domain, so its pages are those of both.
        s, d = add(lambda k, h=host: k[0] == h), add(lambda k, x=domain: k[1] == x)
        s, d = [max(a - b, 0) for a, b in zip(s, q, strict=True)], [max(a - b, 0) for a, b in zip(d, q, strict=True)]
        over = [(d[i] + language.DOMAIN_WEIGHT * base[i]) / (sum(d) + language.DOMAIN_WEIGHT) for i in range(n)]
        post = [e[i] + math.log((s[i] + language.HOST_WEIGHT * over[i]) / (sum(s) + language.HOST_WEIGHT)) for i in range(n)]
        best = max(post)
        out.append((langs[post.index(best)], 1 / sum(math.exp(x - best) for x in post)))
    return out


def test_fused_evidence_equals_a_plain_reading(spark):
    rng = random.Random(9)
    own = {"de": "der die und nicht schön über", "en": "the and with this that from", "fr": "le les une avec être où"}
    words = lambda lang, n: " ".join(rng.choice(own[lang].split()) for _ in range(n))
    labelled = [(words(lang, 30), lang) for lang in own for _ in range(6)] + [(None, "de"), ("x", None)]
    pages = []
    for k in range(40):
        lang, said = rng.choice(list(own)), rng.choice(["de", "EN", "fr", "xx", ""])
        host = rng.choice(["a.one.com", "b.one.com", "WWW.two.de", "three.fr", "x"])
        url = rng.choice([f"http://{host}/{k}", f"https://{host}/{lang}/{k}", f"http://{host}:80/?q"])
        pages.append((url, f'<html lang="{said}"><script>der die das</script><p>{words(lang, rng.choice([0, 1, 2, 60]))}&amp;</p>' if said else f"<p>{words(lang, 3)}"))
    pages += [(None, "<p>und die"), ("no address", None), (None, None), ("http://a.one.com/", "")]
    frame = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: (r.lang, r.probability) for r in language.identify(frame, spark.createDataFrame(labelled, "text string, lang string")).collect()}
    for k, (lang, probability) in enumerate(_plain(pages, labelled)):
        assert got[k][0] == lang and abs(got[k][1] - probability) < 1e-6, (k, pages[k], got[k], lang, probability)
