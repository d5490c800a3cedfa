"""I-Match: the band, the terms that ranges hold, and fingerprints and likeness against brute force."""

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from probelake.llm import imatch

from . import helpers as h


def test_terms_of_one_document_stay_out_of_the_band(spark):
    n, k = 2000, 200  # 400,000 distinct words of one document each
    word = lambda i: F.concat(F.lit("u"), (F.col("id") * k + i).cast("string"))
    docs = spark.range(n).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), word), F.concat(F.lit("Common"), F.col("id") % 20), F.lit("always")).alias("text"))
    want = spark.createDataFrame([(f"common{i}",) for i in range(20)], "w string").select(F.xxhash64("w"))
    assert {r[0] for r in imatch.lexicon(docs).collect()} == {r[0] for r in want.collect()}


def test_each_range_has_its_terms_of_the_band(spark):
    docs = spark.createDataFrame(h.corpus(6), h.SCHEMA).union(spark.createDataFrame([(None, "null id of w1 w2", "en", "s", 1)], h.SCHEMA)).select("doc_id", "text")
    rows = imatch.with_next(docs, "doc_id", "text", 5, copies=True).withColumn("im_text", F.concat("text", F.lit(" "), "im_next"))
    band = {r["term"] for r in imatch.lexicon(docs).collect()}
    got = imatch.with_lexicon(rows, imatch.lexicon(docs), "text").filter("im_copy = 0").select("im_range", imatch.terms(F.col("im_text")).alias("ts"), "im_lex").collect()
    assert len(got) == docs.count() and len({r["im_range"] for r in got}) > 1
    for r in got:
        assert {t for t in r["ts"] if t in r["im_lex"][t & (imatch.BUCKETS - 1)]} == band & set(r["ts"])
    assert band and any(band & set(r["ts"]) for r in got)


def brute_words(t):
    return {w for w in re.split(r"[ \t-\r]+", (t or "").lower()) if w}


def test_fingerprints_and_likeness_equal_brute_force(spark):
    """The terms that count, by plain sets; subsets by the same hashes of single terms."""
    docs = h.corpus(9)
    df = spark.createDataFrame(docs, h.SCHEMA)
    n = len(docs)
    ordered = sorted(docs, key=lambda r: (r[0], r[1] or ""))
    frequency = Counter(w for _, t, *_ in docs for w in brute_words(t))
    least, most = max(imatch.LEAST_DOCS, math.ceil(imatch.LEAST_SHARE * n)), max(imatch.LEAST_DOCS, imatch.MOST_SHARE * n)
    band = {w for w, k in frequency.items() if least <= k <= most}
    texts = []
    for k, (i, t, *_) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % n][1] or ""
        half = len(t) // 2
        texts.append((i, t, t[: len(t) - half] + after[:half], after))
    every = sorted({w for row in texts for t in row[1:] for w in brute_words(t)})
    hashed = {r["w"]: (r["a"], r["b"]) for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("a"), F.xxhash64(F.xxhash64("w"), F.lit(17)).alias("b")).collect()}

    def kept(t):
        """For each subset, the second hashes of the terms that it keeps, in order of the first."""
        ws = brute_words(t)
        inside = [w for w in ws if w in band]
        used = sorted(inside if len(inside) >= imatch.FEWEST else ws, key=lambda w: hashed[w][0])
        out = []
        for j in range(imatch.REPEATS):
            for a in imatch.RATES:
                mask = ((1 << a) - 1) << (10 * j)
                out.append(tuple(hashed[w][1] for w in used if not hashed[w][1] & mask))
        return out

    def likeness(a, b):
        pairs = [(x, y) for x, y in zip(a, b) if x or y]
        return 1.0 if not pairs else sum(x == y for x, y in pairs) / len(pairs)

    got = {(r["doc_id"], r["edited_sha256"]): r for r in _query(spark, df)}
    for i, own, edited, after in texts:
        r = got[i, hashlib.sha256(edited.encode()).hexdigest()]
        a, e, x = kept(own), kept(edited), kept(after)
        assert abs(r["near_edited"] - likeness(a, e)) < 1e-9 and abs(r["near_next"] - likeness(a, x)) < 1e-9
        for text, subsets in ((r["fingerprint"], a), (r["edited_fingerprint"], e)):
            parts = [text[p : p + 8] for p in range(0, len(text), 8)]
            assert len(parts) == len(subsets) and all((p == "00000000") == (not s) for p, s in zip(parts, subsets))
    assert any(0 < r["near_edited"] < 1 for r in got.values()) and any(r["near_next"] == 1 for r in got.values())


def _query(spark, df):
    import tempfile

    d = tempfile.mkdtemp()
    df.write.parquet(f"{d}/documents.parquet")
    return imatch.op3_imatch(spark, d).collect()
