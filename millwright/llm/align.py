"""Cross-tokenizer alignment by diagonal run skipping.

Both tokenizers encode the same bytes, a space and the text, so each token is a byte range and each encoding an
ascending array of end offsets. At the current shift between the two indices the arrays are compared over stretches
that double while they agree and are halved to the first difference: one-to-one stretches are jumped over. Where the
arrays differ, a local walk advances the token that ends first until both end together, which resolves the irregular
group, its overlaps and the new shift. Groups are the cuts at offsets where tokens of both sides end.

Links are the pairs of token occurrences whose byte ranges overlap; the count of an id pair is how many links of all
documents hold it. The counts are gathered by partial sums. The second step brings them back to the documents: the most
frequent pairs (at most ``HEAD`` of them, whatever the data) go to all tasks, which settle almost all links in place;
only pairs beyond these are joined by a shuffle. Each document keeps its distinct pairs, so nothing is encoded twice.

Texts that are null or empty, or whose tokens' joined bytes differ on either side from the space and the text, have no
tokens: all figures are 0 and groups_sha256 is ''. Special tokens' strings in texts are plain text. Texts are encoded
whole: they are cut only before a single space between two characters that are no white space, where a token of either
side always begins (sides for which that does not hold, by their files, are given the text uncut). Repeated rows and
rows with equal or null ids are separate, other columns, whatever their names, are ignored, an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import RID, as_table, column, give_back, materialize, pick, slices, small_batches, strings, worker_state
from millwright.llm.tokenbin import tokenizer_path

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE_BYTES, CACHE_PIECES, JOINED = 1 << 19, 800_000, 8192
HELD_PAIRS = 1 << 20
HEAD = 2_000_000

#: Before such a space a text may be cut. Texts with any of the next one's hits are cut by it alone, others at every space.
CUT = re.compile(r"(?<=\S) (?=\S)")
_BLANK_CUT = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}] | [\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}]|[\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}\x{180e}]|^ | $"


# --- tokenizers -------------------------------------------------------------------------------------------------


class ByteSide:
    """A byte-level BPE of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are plain text
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.byte = {}
        for c in map(chr, range(2048)):
            for b, x in zip(c.encode(), spell(c)[0][0]):
                self.byte[x] = b
        for b in {*range(128, 256)} - {*self.byte.values()}:  # only in longer characters: they stand for themselves
            self.byte[chr(b)] = b
        known = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.bytes[i] = bytes(self.byte.get(c, 63) for c in token)
        spec = json.loads(self.tokenizer.to_str())
        split = spec.get("pre_tokenizer") or {}
        self.cuts = spec["model"]["type"] == "BPE" and spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")

    def __call__(self, pieces: list[str]) -> list[list[int]]:
        """Ids of a space and each piece."""
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]


class PieceSide:
    """A sentencepiece model that puts a space before the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        # No piece has a space after another character, so no merge crosses a cut; and cuts change no neighbour.
        self.cuts = not any("▁" in p.lstrip("▁") for p in names) and self.model.encode("a b  c", out_type=str) == [x for p in ("a", "b  c") for x in self.model.encode(p, out_type=str)]

    def __call__(self, pieces: list[str]) -> list[list[int]]:
        return self.model.encode(pieces, num_threads=1)


class Encoder:
    """Ids of both sides for whole texts, each distinct piece encoded once while it is in the cache."""

    def __init__(self, a: str, b: str, most: int = CACHE_PIECES):
        self.a, self.b, self.most = ByteSide(a), PieceSide(b), most
        self.cuts = self.a.cuts and self.b.cuts
        self.sizes = [np.fromiter(map(len, side.bytes), np.int64, len(side.bytes)) for side in (self.a, self.b)]
        width = max(len(self.a.bytes), len(self.b.bytes))
        digits = [str(i).encode() for i in range(width)]
        self.digits = np.frombuffer(b"".join(digits), np.uint8), np.fromiter(map(len, digits), np.int64, width)
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}  # of each known piece in the arrays below
        self.same = np.zeros(0, bool)
        self.flat = [np.zeros(0, np.int32)] * 2
        self.count = [np.zeros(0, np.int32)] * 2

    def _places(self, pieces: list[str]) -> np.ndarray:
        """The places of distinct pieces; those that are not known yet are encoded."""
        missing = [p for p in pieces if p not in self.places]
        if len(self.places) + len(missing) > self.most:
            self._clear()
            missing = pieces
        if missing:
            ends = [p for p in missing if self.cuts and p and not p[0].isspace() and not p[-1].isspace()]
            alone = [p for p in missing if not (self.cuts and p and not p[0].isspace() and not p[-1].isspace())]
            for lo in range(0, len(ends), JOINED):
                self._learn(ends[lo : lo + JOINED], True)
            if alone:
                self._learn(alone, False)
        return np.fromiter(map(self.places.__getitem__, pieces), np.int64, len(pieces))

    def _learn(self, pieces: list[str], joined: bool) -> None:
        """Put pieces into the cache. Those that may be ``joined`` by single spaces are encoded as one text, which is cut again by bytes."""
        raw = [b" " + p.encode() for p in pieces]
        stops = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        same, new = np.ones(len(pieces), bool), []
        for side, sizes in zip((self.a, self.b), self.sizes):
            if joined:
                ids = np.array(side([" ".join(pieces)])[0], np.int32)
                at = np.cumsum(sizes[ids])
                last = np.searchsorted(at, stops)
                if len(at) and at[-1] == stops[-1] and (at[last] == stops).all() and b"".join(map(side.bytes.__getitem__, ids.tolist())) == b"".join(raw):
                    new.append((ids, np.diff(last, prepend=-1).astype(np.int32)))
                    continue
            found = side(pieces)
            count = np.fromiter(map(len, found), np.int32, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.int32, int(count.sum()))
            ends = np.cumsum(count)
            for i in range(len(pieces)):
                same[i] &= b"".join([side.bytes[x] for x in ids[ends[i] - count[i] : ends[i]]]) == raw[i]
            new.append((ids, count))
        known = len(self.places)
        self.flat = [np.concatenate([x, ids]) for x, (ids, _) in zip(self.flat, new)]
        self.count = [np.concatenate([x, count]) for x, (_, count) in zip(self.count, new)]
        self.same = np.concatenate([self.same, same])
        self.places.update(zip(pieces, range(known, known + len(pieces))))

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts in order, and the text of each."""
        n = len(texts)
        uneven = pc.match_substring_regex(texts, _BLANK_CUT) if self.cuts else pa.array(np.ones(n, bool))
        odd = [CUT.split(t) if self.cuts else [t] for t in texts.filter(uneven).to_pylist()]
        even = pc.invert(uneven)
        parts = pa.concat_arrays([pc.split_pattern(texts.filter(even), " "), pa.array(odd, pa.list_(pa.string()))])
        mask = even.to_numpy(zero_copy_only=False)
        back = np.empty(n, np.int64)
        back[np.concatenate([np.flatnonzero(mask), np.flatnonzero(~mask)])] = np.arange(n)
        parts = parts.take(pa.array(back)) if odd else parts
        return parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64)

    def __call__(self, texts: pa.Array):
        """For texts that are not empty: whether the bytes agree, and per side the ids of those that do and how many each has."""
        n = len(texts)
        pieces, owner = self._pieces(texts)
        coded = pieces.dictionary_encode()
        place = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        good = np.ones(n, bool)
        good[owner[~self.same[place]]] = False
        used = good[owner]
        place, owner = place[used], owner[used]
        out = []
        for flat, count in zip(self.flat, self.count):
            starts = np.cumsum(count, dtype=np.int64) - count
            lengths = count[place].astype(np.int64)
            shift = starts[place] - (np.cumsum(lengths) - lengths)
            out += [flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))].astype(np.int64), np.bincount(owner, lengths, n).astype(np.int64)]
        return good, *out


# --- alignment --------------------------------------------------------------------------------------------------


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First token of each group on both sides, and both ends of each link, in order, for end arrays that end together."""
    n, m = len(ends_a), len(ends_b)
    # Beyond the ends the arrays differ, so no stretch passes them.
    ends = np.append(ends_a, -1).astype("<i8"), np.append(ends_b, -2).astype("<i8")
    raw_a, raw_b = (x.tobytes() for x in ends)
    a, b = (x.tolist() for x in ends)
    runs: list[int] = []  # one-to-one stretches: first token of A, shift, tokens
    odd: list[int] = []  # irregular groups: first and last token of A and of B
    i = j = 0
    while i < n:
        if a[i] == b[j]:
            # Probe at this shift: double the stretch while both arrays agree, then halve to the first difference.
            first, shift, step = i, j - i, 2
            i += 1
            while a[i] == b[i + shift]:
                at = i + shift
                if raw_a[i << 3 : (i + step) << 3] == raw_b[at << 3 : (at + step) << 3]:
                    i += step
                    step *= 2
                    continue
                while step > 1:
                    half, at = step >> 1, i + shift
                    if raw_a[i << 3 : (i + half) << 3] == raw_b[at << 3 : (at + half) << 3]:
                        i += half
                        step -= half
                    else:
                        step = half
            j = i + shift
            runs += (first, shift, i - first)
        else:
            # Walk: the token that ends first gives way, until both end together at a new shift.
            odd += (i, j)
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            odd += (i, j)
            i += 1
            j += 1
    first, shift, size = np.array(runs, np.int64).reshape(-1, 3).T
    one_a = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    one_b = one_a + np.repeat(shift, size)
    from_a, from_b, to_a, to_b = np.array(odd, np.int64).reshape(-1, 4).T
    by = np.argsort(np.concatenate([one_a, from_a]), kind="stable")
    groups = np.concatenate([one_a, from_a])[by], np.concatenate([one_b, from_b])[by]
    # In an irregular group each token that ends is linked with the one of the other side that it ends in.
    in_a, in_b = _spread(from_a, to_a + 1), _spread(from_b, to_b)
    links_a = np.concatenate([one_a, in_a, np.searchsorted(ends_a, ends_b[in_b])])
    links_b = np.concatenate([one_b, np.searchsorted(ends_b, ends_a[in_a]), in_b])
    by = np.argsort(links_a + links_b, kind="stable")  # each link is at least one step further than the one before
    return *groups, links_a[by], links_b[by]


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of ranges."""
    size = hi - lo
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def group_text(ids_a: np.ndarray, ids_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, digits) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` as bytes, each group closed by ``;``, and where each group ends in it."""
    n, m = len(ids_a), len(ids_b)
    size_a, size_b = np.diff(first_a, append=n), np.diff(first_b, append=m)
    # A's tokens stand after the B tokens of earlier groups, B's after the A tokens up to their own group.
    at_a = np.arange(n) + np.repeat(first_b, size_a)
    at_b = np.arange(m) + np.repeat(first_a + size_a, size_b)
    ids = np.empty(n + m, np.int64)
    ids[at_a], ids[at_b] = ids_a, ids_b
    mark = np.full(n + m, ord(","), np.uint8)
    mark[at_a[first_a + size_a - 1]] = ord("|")
    mark[at_b[first_b + size_b - 1]] = ord(";")
    flat, size = digits
    lengths = size[ids] + 1
    ends = np.cumsum(lengths)
    start = (np.cumsum(size) - size)[ids] - (ends - lengths)
    index = np.repeat(start, lengths) + np.arange(int(ends[-1]) if n else 0)
    out = flat[np.minimum(index, len(flat) - 1)]  # the place behind an id takes its mark
    out[ends - 1] = mark
    return out, ends[at_b[first_b + size_b - 1]]


# --- jobs -------------------------------------------------------------------------------------------------------

_SCAN = pa.schema(
    [("rid", pa.struct([("file", pa.int64()), ("row", pa.int64())])), ("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("codes", pa.binary()), ("code", pa.int64()), ("links", pa.int64())]
)
_SCAN_SQL = "rid struct<file:long,row:long>, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, code long, links long"


def pack_codes(codes: np.ndarray, times: np.ndarray, press) -> bytes:
    """Ascending codes with how often each is there."""
    return press(np.concatenate([np.diff(codes, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T.ravel(), times.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()]).tobytes())


def unpack_codes(packed: bytes, open_) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(open_(packed), np.uint8)
    n = len(raw) // 12
    gaps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(gaps.astype(np.int64)), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _rows(n: int, **given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in _SCAN], schema=_SCAN)


def _aligned(encode: Encoder, texts: pa.Array, press):
    """Figures of each text (n_a, n_b, n_groups, n_links), its digest and its packed pairs; all pairs with their counts."""
    n = len(texts)
    figures, shas, packed = np.zeros((4, n), np.int64), [""] * n, [b""] * n
    full = np.flatnonzero(pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    none = np.zeros(0, np.int64)
    if not len(full):
        return figures, shas, packed, none, none
    good, ids_a, n_a, ids_b, n_b = encode(texts.take(pa.array(full)))
    if not len(ids_a):
        return figures, shas, packed, none, none
    first_a, first_b, link_a, link_b = align(np.cumsum(encode.sizes[0][ids_a]), np.cumsum(encode.sizes[1][ids_b]))
    ends = np.cumsum(n_a)  # all texts of the slice stand in one array; a group never passes from one to the next
    group_doc, link_doc = np.searchsorted(ends, first_a, side="right"), np.searchsorted(ends, link_a, side="right")
    groups, links = np.bincount(group_doc, minlength=len(full)), np.bincount(link_doc, minlength=len(full))
    figures[:, full] = n_a, n_b, groups, links
    chars, group_end = group_text(ids_a, ids_b, first_a, first_b, encode.digits)
    view, at = memoryview(chars), 0
    width = len(encode.b.bytes)
    code = ids_a[link_a] * width + ids_b[link_b]
    order = np.lexsort((code, link_doc))
    code, link_doc = code[order], link_doc[order]
    new = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(link_doc, prepend=-1) != 0))
    times, codes, owner = np.diff(new, append=len(code)), code[new], link_doc[new]
    bounds = np.searchsorted(owner, np.arange(len(full) + 1))
    last = np.cumsum(groups)
    for k in np.flatnonzero(groups).tolist():
        end = int(group_end[last[k] - 1])
        shas[full[k]] = hashlib.sha256(view[at : end - 1]).hexdigest()
        at = end
        lo, hi = bounds[k], bounds[k + 1]
        packed[full[k]] = pack_codes(codes[lo:hi], times[lo:hi], press)
    return figures, shas, packed, codes, times


def _sum_by_code(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(np.concatenate(codes), return_inverse=True)
    return values, np.bincount(at, np.concatenate(times), len(values)).astype(np.int64)


def _scan(a: str, b: str):
    """A row for each document, and the pairs of a task with their counts, now and then and at the end."""

    def run(batches):
        from zstandard import ZstdCompressor

        press = ZstdCompressor(level=1).compress
        encode = worker_state().get(("aligner", a, b))
        codes, times, held = [], [], 0
        for batch in slices(batches, "text", SLICE_BYTES):
            if encode is None:
                encode = worker_state()["aligner", a, b] = Encoder(a, b)
            figures, shas, packed, some, often = _aligned(encode, strings(batch, "text").cast(pa.string()), press)
            names = ("n_a", "n_b", "n_groups", "n_links")
            yield _rows(len(batch), rid=column(batch, RID).cast(_SCAN.field("rid").type), doc_id=column(batch, "doc_id").cast(pa.int64()), groups_sha256=pa.array(shas), codes=pa.array(packed, pa.binary()), **{c: pa.array(x) for c, x in zip(names, figures)})
            codes.append(some)
            times.append(often)
            held += len(some)
            if held > HELD_PAIRS:
                some, often = _sum_by_code(codes, times)
                codes, times, held = [some], [often], len(some)
                if held > HELD_PAIRS // 2:
                    yield _rows(held, code=pa.array(some), links=pa.array(often))
                    codes, times, held = [], [], 0
        if held:
            some, often = _sum_by_code(codes, times)
            yield _rows(len(some), code=pa.array(some), links=pa.array(often))
        give_back()

    return run


def pair_counts(scan: DataFrame, width: int) -> DataFrame:
    """code, count, best (whether no pair of its B id has a higher count) of each id pair."""
    counts = scan.where("code is not null").groupBy("code").agg(F.sum("links").alias("count")).withColumn("b", F.pmod("code", F.lit(width)))
    counts = materialize(counts, "align-counts")
    tops = counts.groupBy("b").agg(F.max("count").alias("top"))
    return materialize(counts.join(tops, "b").select("code", "count", (F.col("count") == F.col("top")).alias("best")), "align-pairs")


def frequent(pairs: DataFrame, most: int) -> DataFrame:
    """The most frequent pairs, at most ``most``: those from some count on."""
    level = F.floor(F.log2(F.col("count").cast("double")) * 8)  # a few hundred levels
    have, least = 0, None
    for r in sorted(pairs.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        have += r["count"]
        if have > most:
            break
        least = r["level"]
    return pairs.where(level >= least) if least is not None else pairs.limit(0)


_SUMS_SQL = "rid struct<file:long,row:long>, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, code long, links long"


def _settle(head):
    """Rows of documents with what the frequent pairs give, and a row for each other pair."""

    def run(batches):
        from zstandard import ZstdDecompressor

        open_ = ZstdDecompressor().decompress
        known, count, best = (np.frombuffer(x, t) for x, t in zip(head.value, ("<i8", "<i8", bool)))
        for b in batches:
            if not b.num_rows:
                continue
            sums, bests, rest = [0] * b.num_rows, [0] * b.num_rows, []
            for i, packed in enumerate(column(b, "codes").to_pylist()):
                if not packed:
                    continue
                codes, times = unpack_codes(packed, open_)
                if len(known):
                    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                    hit = known[at] == codes
                    sums[i] = int((times * count[at])[hit].sum())
                    bests[i] = int((times * best[at])[hit].sum())
                else:
                    hit = np.zeros(len(codes), bool)
                if not hit.all():
                    rest.append((np.full(int((~hit).sum()), i), codes[~hit], times[~hit]))
            n = b.num_rows
            cols = [column(b, c) for c in ("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), column(b, "groups_sha256"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            names = [f.split()[0] for f in _SUMS_SQL.replace("file:long,row:long", "").split(", ")]
            yield pa.RecordBatch.from_arrays(cols, names=names)
            if rest:
                owner, codes, times = (np.concatenate(x) for x in zip(*rest))
                void = [pa.nulls(len(codes), c.type) for c in cols]
                void[0], void[-2], void[-1] = cols[0].take(pa.array(owner)), pa.array(codes), pa.array(times)
                yield pa.RecordBatch.from_arrays(void, names=names)

    return run


def align_documents(docs: DataFrame, a: str | None = None, b: str | None = None, head: int = HEAD) -> DataFrame:
    """One row per document: rid, doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a``, ``b``: files of a byte-level BPE and of a sentencepiece model.
    """
    spark = docs.sparkSession
    small_batches(spark)
    a, b = a or tokenizer_path(BYTE_BPE), b or tokenizer_path(PIECE_BPE)
    base = pick(as_table(docs), "doc_id", "text", rid=True)
    scan = materialize(base.mapInArrow(_scan(a, b), _SCAN_SQL), "align-scan")
    pairs = pair_counts(scan, len(PieceSide(b).bytes))
    top = frequent(pairs, head).toArrow().combine_chunks()  # at most ``head`` rows
    order = pc.sort_indices(top["code"])
    sent = [top[c].take(order).to_numpy().astype(t).tobytes() for c, t in (("code", "<i8"), ("count", "<i8"), ("best", bool))]
    rows = scan.where("code is null").select("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes")
    settled = rows.mapInArrow(_settle(spark.sparkContext.broadcast(sent)), _SUMS_SQL)
    if top.num_rows < pairs.count():
        settled = materialize(settled, "align-settled")
        others = settled.where("code is not null").select("rid", "code", "links").join(pairs, "code")
        more = others.groupBy("rid").agg(F.sum(F.col("links") * F.col("count")).alias("more"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"))
        settled = settled.where("code is null").join(more, "rid", "left")
        settled = settled.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0)))
    return settled.select("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
