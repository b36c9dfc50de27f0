"""Language identification by Bayesian evidence fusion.

Four sources of evidence about a page add up as log odds: the likelihood of its text under trigram
models of the languages, its declared markup language, its address suffix, and a prior of its host that
falls back on the host's domain and on all pages (Dirichlet smoothing over grouped sums).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import Stored, map_texts

#: At most so many distinct texts of each language fit the text model; buckets of trigrams.
TRAIN_ROWS, BUCKETS = 300, 1 << 14
#: How far a declaration and an address suffix are trusted, and the weights of a parent's prior.
DECLARED, SUFFIX, HOST_WEIGHT, DOMAIN_WEIGHT = 0.9, 0.8, 5.0, 20.0
_TAG = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;", re.S | re.I)


def _grams(text: str) -> np.ndarray:
    """Counts of the trigrams of a text's letters, by bucket."""
    x = np.frombuffer(" ".join(re.findall(r"[^\W\d_]+", text.lower())).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (x[:-2] * np.uint64(961) + x[1:-1] * np.uint64(31) + x[2:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(50)
    return np.bincount(h.astype(np.int64), minlength=BUCKETS)


def text_model(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of trigrams) from labelled (text, lang), `rows` distinct texts of each at most."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64("text").alias("h"), "text")
    first = Window.partitionBy("lang").orderBy("h")
    few = known.select("lang", "h").distinct().withColumn("k", F.row_number().over(first)).where(F.col("k") <= rows).select("lang", "h")
    table: dict[str, np.ndarray] = {}
    for r in known.join(F.broadcast(few), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).toLocalIterator():
        table[r.lang] = table.get(r.lang, 0.1) + _grams(r.text)
    langs = sorted(table)
    return langs, np.array([np.log(table[x] / table[x].sum()) for x in langs]).reshape(len(langs), BUCKETS)


def _sums(df: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    """Sums of arrays by element, through a row for each element."""
    flat = df.select(*by, F.posexplode(column).alias("i", "v")).groupBy(*by, "i").agg(F.sum("v").alias("v"))
    return flat.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).getField("v").alias(out))


def identify(pages: DataFrame, labelled: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """`pages` (page_id, url, html) with lang and probability.

    A page's own evidence is left out of its host's prior. A null url belongs to no host and takes the
    prior of all pages; null or empty html has no text evidence. Without labelled rows lang is null. Of languages as
    likely the first by name is taken. Pages of any length count whole; repeated rows are pages of their own; other
    columns are left out; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    store = Stored(spark)
    langs, model = text_model(labelled, rows)
    if not langs:
        return pages.select("page_id", "url", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    held, n = spark.sparkContext.broadcast(model), len(langs)

    def make():
        def one(page: str | None) -> list[float]:
            g = _grams(_TAG.sub(" ", page or ""))
            # Trigrams overlap: beyond 30, further ones count by their logarithm only.
            m = max(g.sum(), 1)
            return (held.value @ g * (min(m, 30 + np.log(m)) / m)).tolist()

        return lambda got, _: {"likely": pa.array([one(p) for p in got], pa.list_(pa.float64()))}

    names = F.lit(langs)
    each = lambda f: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)
    vote = lambda col, trust: each(lambda i: F.when(names[i] == col, float(np.log(trust))).when(F.array_contains(names, col), float(np.log((1 - trust) / max(n - 1, 1)))).otherwise(0.0))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]+)", 1))
    host = F.lower(F.regexp_extract("url", r"^\w+://([^/:?#]+)", 1))
    suffix = F.coalesce(F.nullif(F.regexp_extract("url", r"^\w+://[^/]+/([a-z]{2})(?:/|$)", 1), F.lit("")), F.regexp_extract(host, r"\.([a-z]{2})$", 1))
    scored = map_texts(pages.select("page_id", "url", "html"), make, [("likely", T.ArrayType(T.DoubleType()))], column="html", rows=128)
    own = scored.select("page_id", "url", F.coalesce(host, F.lit("")).alias("host"), F.zip_with(F.zip_with("likely", vote(declared, DECLARED), lambda a, b: a + b), vote(F.coalesce(suffix, F.lit("")), SUFFIX), lambda a, b: a + b).alias("e"))
    soft = F.transform("e", lambda x: F.exp(x - F.array_max("e")))
    own = store.put(own.withColumn("q", F.transform(soft, lambda x: x / F.aggregate(soft, F.lit(0.0), lambda a, b: a + b))).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)))
    by_host = store.put(_sums(own, ["host", "domain"], "q", "s"))
    by_domain = _sums(by_host, ["domain"], "s", "d")
    whole = [0.0] * n
    for i, v in by_host.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v")).collect():
        whole[i] = v
    base = [(x + 1) / (sum(whole) + n) for x in whole]
    # A host is one row here, whatever its pages: AQE splits the pages of a hot one over as many tasks as they fill.
    prior = by_host.join(by_domain, "domain").drop("domain")
    met = own.join(prior, "host")
    less = lambda p, i: F.greatest(F.col(p)[i] - F.col("q")[i], F.lit(0.0))
    total = lambda p: F.aggregate(each(lambda i: less(p, i)), F.lit(0.0), lambda a, b: a + b)
    met = met.withColumns({"total_s": total("s"), "total_d": total("d")})
    domain = lambda i: (less("d", i) + DOMAIN_WEIGHT * F.lit(base)[i]) / (F.col("total_d") + DOMAIN_WEIGHT)
    post = each(lambda i: F.col("e")[i] + F.log((less("s", i) + HOST_WEIGHT * domain(i)) / (F.col("total_s") + HOST_WEIGHT)))
    done = met.select("page_id", "url", post.alias("p"))
    best = F.array_max("p")
    return done.select("page_id", "url", F.element_at(names, F.array_position("p", best).cast("int")).alias("lang"), (1 / F.aggregate(F.transform("p", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, b: a + b)).alias("probability"))
