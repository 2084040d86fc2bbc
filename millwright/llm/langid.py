"""Language ID by Bayesian evidence fusion.

For each row the posterior over languages combines

* text: a naive Bayes model over hashed byte trigrams, fitted on labelled documents (at most ``SAMPLE`` of each
  language, the first by a seeded hash of the row), its weight tempered so that a long text is not certain,
* the language declared in the markup (``<html lang=...>``), * the address suffix (last label of the host name),
* a host prior: the host's mix of languages, smoothed towards its site's mix, and that towards the whole table's.

The last three are learned from the table itself by grouped aggregation of text posteriors over all rows; a row's own
posterior is taken out of its host and site counts. Hosts, suffixes and declarations are small aggregates that are
joined back; their hot values are combined before the shuffle.

Whole texts are read, however long. Null or empty text gives equal likelihoods; a null address or declaration is evidence of value ''. Unlabelled tables
give no model: every language is null. Repeated rows are separate rows. Ties go to the first language by code point.
An empty table gives an empty result; other columns are ignored. A model of over ``MODEL_BYTES`` (over 256 languages) is
refused with an error; no label is left out.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.llm.common import RID, as_table, column, join_bounded, materialize, pick, raw_bytes, slices, small_batches, strings

SAMPLE, SEED = 400, 11
DIMS, MODEL_BYTES = 1 << 16, 64 << 20
FULL_WEIGHT = 48  # trigrams that count in full; longer texts weigh as much as that many
KAPPA = 4.0
DROP = re.compile(r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;")
DECLARED = r'(?is)<html\b[^>]*?\blang\s*=\s*["\x27]?\s*([A-Za-z]{2,3})'
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)"


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of lower-cased texts, and the text of each; none across texts."""
    data, offsets = raw_bytes(pc.utf8_lower(texts))
    d = data.astype(np.uint32)
    if len(d) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    code = (d[:-2] * np.uint32(0x9E3779B1) ^ d[1:-1] * np.uint32(0x85EBCA77) ^ d[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
    own = np.repeat(np.arange(len(texts)), np.diff(offsets))
    inside = own[:-2] == own[2:]
    return code[inside], own[:-2][inside]


def _count(batches):
    """Trigram counts of each language in a slice."""
    for b in slices(batches, "text"):
        langs = column(b, "lang").dictionary_encode()
        codes, own = _codes(strings(b, "text").cast(pa.string()))
        pair = langs.indices.to_numpy(zero_copy_only=False)[own].astype(np.int64) * DIMS + codes
        key, n = np.unique(pair, return_counts=True)
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key // DIMS)), pa.array(key % DIMS), pa.array(n)], names=["lang", "dim", "n"])


def chosen_rows(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Row ids (RID) and languages of the rows that the model is fitted on, written out. No text moves here.

    Hashes of places are uniform, so four times the share that is wanted leaves enough of each language, and little to
    rank; the row of the lowest hash stays in any case, and with it its language.
    """
    keyed = labelled.where("lang is not null").select(RID, "lang", (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", RID), 11) / F.lit(float(1 << 53))).alias("key"))
    counts = materialize(keyed.groupBy("lang").agg(F.count("*").alias("rows"), F.min("key").alias("least")), "lang-counts")
    few = join_bounded(keyed, counts, ["lang"], "inner").where((F.col("key") * F.col("rows") <= 4 * sample) | (F.col("key") == F.col("least")))
    first = F.row_number().over(W.partitionBy("lang").orderBy("key", RID))
    return materialize(few.select(RID, "lang", first.alias("r")).where(F.col("r") <= sample).select(RID, "lang"), "lang-sample")


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities (languages x DIMS) from the columns doc_id, lang, text of ``docs``."""
    labelled = pick(as_table(docs), "doc_id", "lang", "text", rid=True)
    chosen = chosen_rows(labelled, sample)
    langs = [r["lang"] for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MODEL_BYTES // (4 * DIMS) + 1).collect()]
    if 4 * DIMS * len(langs) > MODEL_BYTES:
        raise ValueError(f"over {MODEL_BYTES // (4 * DIMS)} languages: the model would pass {MODEL_BYTES} bytes")
    langs.sort()
    texts = join_bounded(labelled.select(RID, "text"), chosen, [RID], "inner").select("lang", "text")
    counts = texts.mapInArrow(_count, "lang string, dim long, n long").groupBy("lang", "dim").agg(F.sum("n").alias("n"))
    one = counts.groupBy("lang").agg(F.collect_list("dim").alias("dims"), F.collect_list("n").alias("ns"))  # at most DIMS of each
    table = np.full((len(langs), DIMS), 0.1)
    for r in one.toLocalIterator():
        table[langs.index(r["lang"]), r["dims"]] += r["ns"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _score(keep: list[str], weights, n_langs: int, html: bool):
    def run(batches):
        table = weights.value
        for b in slices(batches, "body"):
            texts = strings(b, "body").cast(pa.string())
            if html:
                texts = pa.array([DROP.sub(" ", t) for t in texts.to_pylist()], pa.string())
            codes, own = _codes(texts)
            n = np.bincount(own, minlength=len(b))
            logs = np.stack([np.bincount(own, table[k][codes], len(b)) for k in range(n_langs)], axis=1).astype(np.float64) if n_langs else np.zeros((len(b), 0))
            logs *= (np.minimum(n, FULL_WEIGHT) / np.maximum(n, 1))[:, None]
            flat = pa.array((logs - logs.max(axis=1, keepdims=True)).ravel() if n_langs else np.zeros(0), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * n_langs, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in keep), lists], names=[*keep, "ll"])

    return run


def score_text(rows: DataFrame, model: tuple[list[str], np.ndarray], html: bool) -> DataFrame:
    """Replace ``body`` by the tempered log likelihoods ``ll`` of the languages."""
    langs, table = model
    keep = [c for c in rows.columns if c != "body"]
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    weights = rows.sparkSession.sparkContext.broadcast(table)  # MODEL_BYTES at most
    return rows.mapInArrow(_score(keep, weights, len(langs), html), f"{types}, ll array<double>")


def fuse(scored: DataFrame, langs: list[str], kappa: float = KAPPA) -> DataFrame:
    """Add lang, confidence and text_lang to rows with ll, host, site, suffix and declared (strings without nulls)."""
    if not langs:
        return scored.withColumns({"lang": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "text_lang": F.lit(None).cast("string")})
    k = range(len(langs))
    soft = F.transform("ll", lambda x: F.exp(x))
    rows = scored.withColumn("soft", soft).withColumn("p", F.transform("soft", lambda x: x / F.aggregate("soft", F.lit(0.0), lambda a, y: a + y))).drop("soft")
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in k]
    vector = F.array(*[F.col(f"s{i}") for i in k])
    # Written out, so that the joins below have plain exchanges on both sides and Spark may split a hot host.
    by_key = {c: materialize(rows.groupBy(c).agg(*sums).select(c, vector.alias(f"{c}_n")), f"lang-{c}") for c in ("declared", "suffix", "site", "host")}
    # The whole table's mix: one row, a number for each language.
    whole = rows.agg(*sums).first()
    mix = [float(x or 0) + 1.0 for x in whole]
    glob = F.array(*[F.lit(x / sum(mix)) for x in mix])
    rows = reduce(lambda df, c: df.join(by_key[c], c), ("host", "site", "suffix", "declared"), rows)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, y: a + y)

    def smooth(counts, below):
        """(counts without the row's own + kappa * mix below) / total."""
        own = F.zip_with(counts, F.col("p"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
        return F.zip_with(own, below, lambda a, b: (a + F.lit(kappa) * b) / (F.greatest(total(counts) - 1, F.lit(0.0)) + F.lit(kappa)))

    rows = rows.withColumn("prior", smooth(F.col("site_n"), glob)).withColumn("prior", smooth(F.col("host_n"), F.col("prior")))

    def evidence(c):
        """log P(value | language), the value's counts against all rows of the language; '' says nothing."""
        ratio = F.zip_with(F.col(f"{c}_n"), glob, lambda a, g: F.log((a + F.lit(kappa) * g) / (F.lit(sum(mix)) * g + F.lit(kappa))))
        return F.when(F.col(c) == "", F.transform(ratio, lambda x: F.lit(0.0))).otherwise(ratio)

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = reduce(add, [F.col("ll"), F.transform("prior", lambda x: F.log(x)), evidence("declared"), evidence("suffix")])
    rows = rows.withColumn("log", logs)
    names = F.array(*map(F.lit, langs))
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    rest = F.aggregate(F.transform("log", lambda x: F.exp(x - F.array_max("log"))), F.lit(0.0), lambda a, y: a + y)
    return rows.withColumns({"lang": best("log"), "confidence": F.round(1 / rest, 6), "text_lang": best("ll")})


def address(url):
    """host, site (last two labels) and suffix columns of an address; '' where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))
    return {"host": host, "site": F.substring_index(host, ".", -2), "suffix": F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1)).otherwise("")}


def identify(docs: DataFrame, pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per page and per document: doc_id or page_id, host, suffix, declared, lang, confidence, text_lang.

    Documents lend their labels to the text model; their host is their source, and they declare nothing.
    """
    small_batches(docs.sparkSession)
    model = fit(docs, sample)
    d = pick(docs, "doc_id", "source", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.coalesce("source", F.lit("")).alias("host"), F.coalesce("source", F.lit("")).alias("site"), F.lit("").alias("suffix"), F.lit("").alias("declared"), F.col("text").alias("body"))
    p = pick(pages, "page_id", "url", "html").withColumns(address(F.col("url")))
    p = p.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), "host", "site", "suffix", F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), DECLARED, 1)).alias("declared"), F.col("html").alias("body"))
    scored = materialize(score_text(d, model, False).unionByName(score_text(p, model, True)), "lang-scored")
    return fuse(scored, model[0]).select("doc_id", "page_id", "host", "suffix", "declared", "lang", "confidence", "text_lang")
