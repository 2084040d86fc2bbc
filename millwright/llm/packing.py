"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest capacity give full pieces and a rest. Within blocks of about ``block_docs``
documents (dealt by hash, so that no task grows with the table) pieces are placed largest first into the open bin that
they fill best. If none has room, every permitted length that holds the piece is weighed: what it would hold if the
pieces that are left filled it largest first, against what a sequence of that length costs (``overhead`` for the
sequence, one for each word place, and attention, which grows with the square of the length). The length of least cost
a word is opened, so short lengths are opened while the pieces that are left fill them, and long ones where they do
not. At the end each bin shrinks to the smallest permitted length that holds its contents.

Sizes are words ``[^\\x20\\x09-\\x0D]+``. Null and wordless texts give one row in no bin (bin_id null). Repeated rows and
equal ids are separate; ties go by id, then row. Very long texts are cut only at multiples of the largest length. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import RID, give_back, materialize, pick, word_count

CAPACITIES, OVERHEAD, ATTENTION, BLOCK_DOCS, SEED = (512, 1024, 2048, 4096), 32, 8192, 3000, 5


def cost(capacity: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    """What a sequence of a length costs, in word places; at ``attention`` words attention costs as much as all else."""
    return overhead + capacity + capacity * capacity / attention


def best_fit(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """For sizes in descending order, none above the largest capacity: bin and offset of each; final capacity, fill and opened capacity of each bin."""
    bins, offsets, used, opened = [], [], [], []
    free: dict[int, list[int]] = {}  # open bins by room left
    rooms = 0  # which rooms occur
    left = Counter(sizes)
    waiting = sum(1 << s for s in left)  # which sizes are left to place

    def fill(room: int) -> int:
        """Words that go into the room if the largest of the pieces left go first."""
        held, top = 0, room
        while found := waiting & ((1 << (min(room, top) + 1)) - 1):
            s = found.bit_length() - 1
            n = min(left[s], room // s)
            held, room, top = held + n * s, room - n * s, s - 1
        return held

    for s in sizes:
        left[s] -= 1
        if not left[s]:
            waiting ^= 1 << s
        fits = rooms >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                rooms ^= 1 << r
        else:
            r = min((c for c in capacities if c >= s), key=lambda c: (cost(c, overhead, attention) / (s + fill(c - s)), c))
            b = len(used)
            used.append(0)
            opened.append(r)
        bins.append(b)
        offsets.append(used[b])
        used[b] += s
        if r > s:
            free.setdefault(r - s, []).append(b)
            rooms |= 1 << (r - s)
    final = [next(c for c in sorted(capacities) if c >= u) for u in used]
    return bins, offsets, final, used, opened


SCHEMA = "doc_id long, piece int, piece_start long, n_words long, bin_id long, bin_capacity int, bin_offset int, bin_used int, bin_opened int"


def _pack(capacities, overhead, attention):
    top = max(capacities)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        items, none = [], []
        for rid, doc, size in zip(pdf[RID], pdf["doc_id"], pdf["size"]):
            full = size // top
            items += [(-top, doc, rid, p, p * top) for p in range(full)]
            if size % top:
                items.append((-(size % top), doc, rid, full, full * top))
            if not size:
                none.append((doc, 0, 0, 0, None, None, None, None, None))
        items.sort(key=lambda x: (x[0], pd.isna(x[1]), 0 if pd.isna(x[1]) else x[1], x[2], x[3]))
        bins, offsets, caps, used, opened = best_fit([-x[0] for x in items], capacities, overhead, attention)
        first = int(key[0]) << 32
        rows = [(x[1], x[3], x[4], -x[0], first + b, caps[b], o, used[b], opened[b]) for x, b, o in zip(items, bins, offsets)]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        give_back()
        return pd.DataFrame(rows + none, columns=names).astype({n: "Int64" for n in names})

    return run


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per piece: where the piece starts in its document, and its bin, the bin's capacity, fill, the offset in it and the capacity that it was opened with."""
    base = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias(RID), F.col("doc_id").cast("long").alias("doc_id"), word_count().alias("size"))
    base = materialize(base, "pack-sizes")
    blocks = max(1, -(-base.count() // block_docs))
    dealt = base.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", RID), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(_pack(tuple(capacities), overhead, attention), SCHEMA)
