"""Line deduplication across documents.

A line's key is the line without white space at both ends and with A-Z lower-cased. Keys of at least `min_chars` code
points found in at least `min_docs` documents stay in the largest doc_id that holds them and go everywhere else.

Only hashes travel: lines become (128-bit key hash, document, position), are range-partitioned by hash and document and
sorted by hash, document from the largest down, and position. A task streams its rows and knows what to drop as soon as a
hash ends; the range bounds include the document, so a line that a third of all documents hold is spread over many
tasks. A hash that crosses a task's border is at its first or last run: such runs are settled by a summary of at most two
rows a task. What comes back to the documents is one compressed keep bitmap each, never text.

Defined cases: null or empty text is one empty line; a null doc_id is one document below all others; rows that repeat a
doc_id are one document when documents are counted, and each keeps its own text; a key repeated within the largest
document stays each time. Extra columns pass through, whatever they are called; only those under the two names of the counts are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpost.llm.common import SPACE, as_bytes, lower_ascii, slices

_RUNS = "h long, g long, doc long, row long, pos int, kind int, n_docs long, top long"
#: kind: a line to drop, a line whose run may go on in another task, and the summary of such a run.
DROP, OPEN, RUN = 0, 1, 2
#: Rows of one hash of one document that a task looks at once.
_CHUNK = 65536


def _row_key(df: DataFrame):
    """What tells rows apart that share a doc_id: a hash of the text."""
    return F.xxhash64(F.coalesce(df["text"], F.lit("")))


def _doc_key(df: DataFrame):
    return F.coalesce(df["doc_id"].cast("long"), F.lit(-(2**63)))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line that may be dropped: 128 bits of its key's hash, document, row and position."""
    lines = docs.select(_doc_key(docs).alias("doc"), _row_key(docs).alias("row"), F.posexplode(F.split(docs["text"], "\n", -1)).alias("pos", "line"))
    key = F.btrim(lower_ascii(F.col("line")), F.lit(SPACE))
    keyed = lines.select("doc", "row", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(7), "key").alias("g"), "doc", "row", "pos")


def _stream(min_docs: int):
    """Turns a sorted partition into decisions, a batch at a time; only the first and the last hash are left open."""

    def table(h, g, doc, row, pos, kind, n_docs, top) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(pos, pa.int32()), pa.array(kind, pa.int32()), pa.array(n_docs, pa.int64()), pa.array(top, pa.int64())], ["h", "g", "doc", "row", "pos", "kind", "n_docs", "top"])

    def rows(part: dict, at: np.ndarray, kind: int) -> pa.RecordBatch:
        zero = np.zeros(len(at), np.int64)
        return table(part["h"][at], part["g"][at], part["doc"][at], part["row"][at], part["pos"][at], np.full(len(at), kind, np.int32), zero, zero)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The hash that is being read: its documents so far, its largest document, its last one, and whether it is the first.
        now = None
        # Lines of the current hash outside its largest document, until it has enough documents to drop them as they come.
        held: list[dict] = []

        def closed(last: bool) -> Iterator[pa.RecordBatch]:
            if now["first"] or last:
                yield table([now["h"]], [now["g"]], [now["top"]], [0], [0], [RUN], [now["n"]], [now["top"]])
            elif now["n"] >= min_docs:
                for x in held:
                    yield rows(x, np.arange(len(x["h"])), DROP)
            held.clear()

        for batch in batches:
            part = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
            h, g, doc = part["h"], part["g"], part["doc"]
            if not len(h):
                continue
            starts = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
            ends = np.append(starts[1:], len(h))
            new_doc = np.concatenate(([True], (doc[1:] != doc[:-1])))
            new_doc[starts] = True
            docs_in = np.add.reduceat(new_doc.astype(np.int64), starts)
            if len(starts) > 2:  # runs that begin and end in this batch and are neither its first nor its last
                inner = np.arange(1, len(starts) - 1)
                gone = inner[docs_in[inner] >= min_docs]
                if len(gone):
                    at = np.concatenate([np.arange(starts[i], ends[i]) for i in gone])
                    top = np.repeat(doc[starts[gone]], ends[gone] - starts[gone])
                    at = at[doc[at] != top]
                    settled = rows(part, at, DROP)
                else:
                    settled = None
            else:
                settled = None
            for i in dict.fromkeys((0, len(starts) - 1)):
                a, b = starts[i], ends[i]
                if now is None or now["h"] != h[a] or now["g"] != g[a]:
                    if now is not None:
                        yield from closed(False)
                    # A hash met after the partition's first one can only be open at the end.
                    now = {"h": h[a], "g": g[a], "n": 0, "top": doc[a], "doc": None, "first": now is None}
                now["n"] += int(docs_in[i]) - (now["doc"] is not None and now["doc"] == doc[a])
                now["doc"] = doc[b - 1]
                held.append({k: v[a:b].copy() for k, v in part.items()} if now["first"] else {k: v[a:b][doc[a:b] != now["top"]] for k, v in part.items()})
                if now["first"] or sum(len(x["h"]) for x in held) > _CHUNK:  # lines of a long run leave memory as open ones
                    now["first"] = True
                    for x in held:
                        yield rows(x, np.arange(len(x["h"])), OPEN)
                    held.clear()
                if i == 0 and settled is not None:
                    yield settled
        if now is not None:
            for x in held:
                yield rows(x, np.arange(len(x["h"])), OPEN)
            held.clear()
            yield from closed(True)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed keep bits of each document up to its last dropped line; lines after that stay."""
    for batch in slices(batches, 4096):
        maps = []
        for gone in batch.column(2).to_pylist():
            keep = np.ones(max(gone) // 8 * 8 + 8, bool)  # whole bytes: the packed padding would read as dropped
            keep[gone] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], ["doc", "row", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """(doc, row, keep_bitmap) for every document that loses a line; bit i of the zlib-packed bits tells whether line i stays."""
    lines = hashed_lines(docs, min_chars)
    order = [F.col("h"), F.col("g"), F.col("doc").desc()]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order, "row", "pos")
    runs = dealt.mapInArrow(_stream(min_docs), _RUNS)
    # Two rows a task and one for each very long run: small, but left to Spark to broadcast or shuffle by its real size.
    border = runs.where(F.col("kind") == RUN).groupBy("h", "g").agg(F.sum("n_docs").alias("n"), F.max("top").alias("keeps")).where(F.col("n") >= min_docs)
    settled = runs.where(F.col("kind") == DROP).select("doc", "row", "pos")
    open_ = runs.where(F.col("kind") == OPEN).join(border, ["h", "g"]).where(F.col("doc") != F.col("keeps")).select("doc", "row", "pos")
    gone = settled.unionByName(open_).groupBy("doc", "row").agg(F.collect_set("pos").alias("gone"))
    return gone.mapInArrow(_bitmaps, "doc long, row long, keep_bitmap binary")


def _apply(at_text: int, at_map: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, packed in zip(as_bytes(batch.column(at_text)), batch.column(at_map).to_pylist(), strict=True):
                n, gone = text.count(b"\n") + 1, 0
                if packed is not None:
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8)).astype(bool)
                    lines = text.split(b"\n")
                    stays = [x for i, x in enumerate(lines) if i >= len(keep) or keep[i]]
                    gone = n - len(stays)
                    text = b"\n".join(stays)
                texts.append(text)
                n_lines.append(n)
                n_dropped.append(gone)
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at_text else batch.column(i) for i in range(batch.num_columns) if i != at_map]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names)

    return run


def drop_repeated_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with `text` cut to the lines that stay, and the numbers of lines before and of lines dropped under `names`."""
    docs = docs.drop(*names)
    bitmaps = keep_bitmaps(docs, min_docs, min_chars)
    # Plain names on the way into Python, whatever the columns are called.
    plain = [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)]
    joined = docs.join(bitmaps, (_doc_key(docs) == bitmaps["doc"]) & (_row_key(docs) == bitmaps["row"]), "left").select(*plain, bitmaps["keep_bitmap"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(_apply(docs.columns.index("text"), len(docs.columns), [*docs.columns, *names]), f"{kinds}, `{names[0]}` long, `{names[1]}` long")
