"""Ranked and plain text search, and the inverted index."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.batches import slices, small_batches
from millwright.sources.shared import materialize

TERM = r"[a-z0-9]+"
K1, B = 1.2, 0.75


def query_phrases(query: str, most: int = 12) -> list[list[str]]:
    """Tokens of a query, each a phrase of index terms; a query without tokens is one phrase."""
    tokens = re.findall(r"[A-Za-z0-9_.$\[\]-]+", query)[:most] or [query]
    return [p for p in (re.findall(TERM, t.lower()) for t in tokens) if p]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def build_index(docs: DataFrame, key: str, text: str, by: str | None = None) -> DataFrame:
    """term, key, tf, positions (and ``by``, a column of ``docs``): the postings, one row for each term of a document.

    A posting lies within one document, so it is made where the document is read, without a shuffle; store it with
    ``write_index``, which deals it by term. Texts come to Python and are cut into terms a few megabytes at a time.
    """
    small_batches(docs.sparkSession)
    more = [F.col(by).alias("by")] if by else []
    bare = docs.select(F.col(key).alias("key"), F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ").alias("text"), *more)
    kind = lambda c: bare.schema[c].dataType.simpleString()
    rows = bare.mapInArrow(_postings, f"term string, key {kind('key')}, tf long, positions array<int>" + (f", by {kind('by')}" if by else ""))
    return rows.withColumnRenamed("key", key).withColumnRenamed("by", by or "by")


def _postings(batches):
    for batch in slices(batches, "text"):
        words = pc.ascii_split_whitespace(pc.fill_null(batch["text"], "").cast(pa.string()))
        doc, word = pc.list_parent_indices(words), words.flatten()
        full = pc.greater(pc.binary_length(word), 0)
        doc, coded = doc.filter(full).to_numpy(zero_copy_only=False).astype(np.int64), word.filter(full).dictionary_encode()
        if not len(doc):
            continue
        at = np.arange(len(doc)) - np.searchsorted(doc, doc)  # texts stand in order, so each begins where it is first found
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pair = doc * len(coded.dictionary) + code
        order = np.argsort(pair, kind="stable")
        starts = np.flatnonzero(np.diff(pair[order], prepend=-1))
        ends = np.append(starts[1:], len(order))
        first = order[starts]
        positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), pa.array(at[order], pa.int32()))
        owner = pa.array(doc[first])
        more = {"by": batch["by"].take(owner)} if "by" in batch.schema.names else {}
        yield pa.RecordBatch.from_pydict({"term": coded.dictionary.take(pa.array(code[first])), "key": batch["key"].take(owner), "tf": pa.array(ends - starts), "positions": positions, **more})


def write_index(docs: DataFrame, key: str, text: str, path: str, partitions: int | None = None, by: str | None = None) -> None:
    """Store ``docs`` with their lengths (``path/documents``), the postings in ranges of terms, sorted (``path/postings``), and how many documents, texts and terms there are (``path/statistics``).

    A null text has no length, as in ``ranked``: it counts as a document, not in the mean length.
    ``by``: a column that postings keep and statistics are kept by, such as the project.
    """
    low = F.lower(text)
    docs.withColumn("length", F.regexp_count(low, F.lit(TERM))).write.mode("overwrite").parquet(f"{path}/documents")
    stored = docs.sparkSession.read.parquet(f"{path}/documents")
    rows = build_index(stored, key, text, by)
    dealt = rows.repartitionByRange(partitions, "term", key) if partitions else rows.repartitionByRange("term", key)
    dealt.sortWithinPartitions("term", key).write.mode("overwrite").parquet(f"{path}/postings")
    stored.groupBy(*([by] if by else [])).agg(F.count("*").alias("documents"), F.count("length").alias("texts"), F.sum(F.col("length").cast("long")).alias("terms")).write.mode("overwrite").parquet(f"{path}/statistics")


def phrase_hits(postings: DataFrame, key: str, phrase: list[str], i: int) -> DataFrame:
    """key and ``at{i}``, the places of a phrase of adjacent terms; each term's postings are read by their range."""
    hits = None
    for j, term in enumerate(phrase):
        one = postings.where(F.col("term") == term).select(key, _shifted(j).alias("at"))
        hits = one if hits is None else hits.join(one.withColumnRenamed("at", "next"), key).select(key, F.array_intersect("at", "next").alias("at"))
    return hits.where(F.size("at") > 0).select(key, F.col("at").alias(f"at{i}"))


def ranked_by_index(documents: DataFrame, postings: DataFrame, key: str, query: str, statistics: DataFrame | None = None, places: bool = False) -> DataFrame:
    """``ranked`` from a stored index: only the postings of the query's terms are read, and lengths of their documents.

    Statistics are those of the whole index, stored (else counted). A phrase is found by its positions; ``places`` adds
    them, an array for each phrase. One job gives the document frequencies of all phrases.
    """
    phrases = query_phrases(query)
    if not phrases:
        none = documents.select(key, F.lit(0.0).alias("score")).limit(0)
        return none.withColumn("places", F.lit(None).cast("array<array<int>>")) if places else none
    if statistics is None:
        n, mean = documents.agg(F.count("*"), F.avg("length")).first()
    else:
        texts = F.coalesce("texts", "documents") if "texts" in statistics.columns else F.col("documents")  # older stores lack it
        n, texts, terms_ = statistics.agg(F.sum("documents"), F.sum(texts), F.sum("terms")).first()
        mean = (terms_ or 0) / texts if texts else 0.0
    hits = [phrase_hits(postings, key, p, i) for i, p in enumerate(phrases)]
    df = {r["i"]: r["df"] for r in reduce(DataFrame.unionByName, [h.select(F.lit(i).alias("i")) for i, h in enumerate(hits)]).groupBy("i").agg(F.count("*").alias("df")).collect()}
    found = reduce(lambda a, b: a.join(b, key), hits)
    scored = found.join(documents.select(key, F.col("length").alias("len")), key)
    score = reduce(lambda a, b: a + b, [_term_score(F.size(f"at{i}"), df.get(i, 0), n or 0, mean or 1.0) for i in range(len(phrases))])
    out = scored.select(key, F.round(score, 6).alias("score"), *([F.array(*[f"at{i}" for i in range(len(phrases))]).alias("places")] if places else []))
    return out


def _shifted(by: int) -> Column:
    return F.transform("positions", lambda x: x - by)


def _term_score(f: Column, df: int, n: int, mean: float) -> Column:
    idf = F.ln(F.lit((n - df + 0.5) / (df + 0.5) + 1.0))
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.lit(float(mean))))


def _occurrences(tokens: Column, phrase: list[str]) -> Column:
    """How often a phrase occurs in an array of terms."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - len(phrase) + 1, F.lit(1)))
    wanted = F.array(*map(F.lit, phrase))
    return F.size(F.filter(starts, lambda i: F.slice(tokens, i, len(phrase)) == wanted))


def ranked(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key, score of the documents that have every phrase of the query: Okapi BM25, best first.

    Lengths and document frequencies come from one aggregate over all documents; a literal test on the text lets
    only candidates be counted.
    """
    phrases = query_phrases(query)
    if not phrases:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    low = F.lower(F.col(text))
    maybe = [reduce(lambda a, b: a & b, [F.contains(low, F.lit(t)) for t in p]) for p in phrases]
    rows = docs.select(F.col(key), terms(F.col(text)).alias("t"), *[m.alias(f"m{i}") for i, m in enumerate(maybe)])
    counts = rows.select(key, F.size("t").alias("len"), *[F.when(F.col(f"m{i}"), _occurrences(F.col("t"), p)).otherwise(0).alias(f"f{i}") for i, p in enumerate(phrases)])
    counts = materialize(counts, "bm25")  # texts are read and cut into terms once
    n, mean, *df = counts.agg(F.count("*"), F.avg("len"), *[F.count_if(F.col(f"f{i}") > 0) for i in range(len(phrases))]).first()
    score = reduce(lambda a, b: a + b, [_term_score(F.col(f"f{i}"), d, n, mean or 1.0) for i, d in enumerate(df)])
    hit = reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in range(len(phrases))])
    return counts.where(hit).select(key, F.round(score, 6).alias("score"))


def search(docs: DataFrame, key: str, name: str, text: str, query: str, kinds: list[str] | None = None, scope: str | None = None, postings: DataFrame | None = None, statistics: DataFrame | None = None, places: bool = False) -> DataFrame:
    """Ranked hits; where there are none, rows whose text or name contains the query (score 0).

    With ``postings`` (``docs`` then has ``length``) the stored index answers, and with ``places`` says where the phrases stand.
    """
    none = F.lit(None).cast("array<array<int>>")
    more = lambda rows: rows.withColumn("places", none) if places else rows
    if not query.strip():
        return more(docs.select("*", F.lit(0.0).alias("score")).limit(0))
    hits = more(ranked(docs, key, text, query)) if postings is None else ranked_by_index(docs, postings, key, query, statistics, places)
    if kinds:
        docs = docs.where(F.col("kind").isin(*kinds))
    if scope:
        docs = docs.where(F.col("scope") == scope)
    found = docs.join(hits, key)
    if found.isEmpty():
        q = query.lower()
        return more(docs.where(F.contains(F.lower(text), F.lit(q)) | F.contains(F.lower(name), F.lit(q))).withColumn("score", F.lit(0.0)))
    return found


# --- snippets ---------------------------------------------------------------------------------------------------

SNIPPET_TOKENS, OPEN, CLOSE, ELLIPSIS = 32, "[", "]", " ... "


def covering_window(places: list[list[int]], lengths: list[int], width: int) -> tuple[int, int]:
    """First token and number of tokens of the window that shows most: the most phrases, then most of their occurrences, then the first.

    Occurrences are merged into one list by place; two ends run over it, so that each occurrence enters and leaves once.
    """
    merged = sorted((at, at + n, i) for i, (ats, n) in enumerate(zip(places, lengths)) for at in ats)
    if not merged:
        return 0, width
    best, have, lo = None, [0] * len(places), 0
    for hi, (_, end, i) in enumerate(merged):
        have[i] += 1
        while end - merged[lo][0] > width and lo < hi:
            have[merged[lo][2]] -= 1
            lo += 1
        rank = (sum(n > 0 for n in have), sum(have), -merged[lo][0])
        if best is None or rank > best[0]:
            best = rank, merged[lo][0], max(e for _, e, _ in merged[lo : hi + 1])
    _, first, end = best
    return max(0, first - max(0, width - (end - first)) // 2), width


def marked(text: str, places: list[list[int]], lengths: list[int], width: int = SNIPPET_TOKENS) -> str:
    """The window of a text with the hits in brackets, and dots where it does not begin or end the text."""
    tokens = [m.span() for m in re.finditer(TERM, (text or "").lower())]
    if not tokens:
        return text or ""
    first, n = covering_window(places, lengths, width)
    first = max(0, min(first, len(tokens) - n))
    last = min(len(tokens), first + n)
    runs = sorted({(at, at + k) for ats, k in zip(places, lengths) for at in ats if first <= at and at + k <= last})
    out, at = [], tokens[first][0] if first else 0
    for a, b in runs:
        lo, hi = tokens[a][0], tokens[b - 1][1]
        if lo < at:  # it lies within the hit before
            continue
        out += [text[at:lo], OPEN, text[lo:hi], CLOSE]
        at = hi
    end = tokens[last - 1][1] if last < len(tokens) else len(text)
    return f"{ELLIPSIS if first else ''}{''.join(out)}{text[at:end]}{ELLIPSIS if last < len(tokens) else ''}"


def snippets(hits: DataFrame, text: str, query: str, out: str = "snippet", width: int = SNIPPET_TOKENS) -> DataFrame:
    """Replace ``places`` of ranked hits by the text's best window; without places the text's beginning."""
    lengths = [len(p) for p in query_phrases(query)]
    names = [c for c in hits.columns if c != "places"]
    kinds = ", ".join(f"`{c}` {hits.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for b in batches:
            found = [marked(t, [list(x) for x in p or []], lengths, width) for t, p in zip(b.column(b.schema.get_field_index(text)).to_pylist(), b.column(b.schema.get_field_index("places")).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(found, pa.string())], names=[*names, out])

    return hits.mapInArrow(run, f"{kinds}, `{out}` string")
