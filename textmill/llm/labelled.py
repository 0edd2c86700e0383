"""What the two classifiers share: the bounded sample of labelled rows, and word hashing."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_fold

#: Words that a worker keeps with their hashes.
CACHE_WORDS = 200_000
#: Characters of a text that may be learnt from: with the bound on rows it bounds the sample, at 300 MB for 6,000 rows.
TRAIN_CHARS = 50_000
CUT = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_seen: dict[str, int] = {}


def tokens(text: str | None) -> list[str]:
    """Runs of letters and digits, and runs of other signs; case is kept."""
    return CUT.findall(text or "")


def hashes(words: list[str]) -> list[int]:
    """32-bit hashes, the same in every process."""
    get = _seen.get
    out = []
    for w in words:
        h = get(w)
        if h is None:
            if len(_seen) >= CACHE_WORDS:
                _seen.clear()
            h = _seen[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        out.append(h)
    return out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """(text, label) of at most `rows` labelled rows outside the held-out fold: half of them, if there are as many, with the rarer label.

    Which rows are taken depends on a hash of the id only; of these, texts of over TRAIN_CHARS characters are left out.
    Labels choose rows and are learnt from; they are in no score.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~labelled_fold(doc_id)).select(doc_id, F.col(label).cast("int").alias("y"))
    known = known.groupBy(doc_id).agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = []
    for y in counts:
        other = sum(n for z, n in counts.items() if z != y)
        n = max(rows // 2, rows - other)
        picked.append(known.filter(F.col("y") == y).orderBy(F.xxhash64(doc_id), doc_id).limit(min(n, counts[y])))
    if not picked:
        return []
    ids = picked[0]
    for x in picked[1:]:
        ids = ids.unionByName(x)
    found = docs.select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("t")).filter(F.length("t") <= TRAIN_CHARS).join(ids, doc_id).orderBy(F.xxhash64(doc_id), doc_id, "t").limit(rows)
    return [(r["t"], r["y"]) for r in found.select("t", "y").collect()]
