"""Token ids of documents in coded files: encode, write in ascending doc_id order, read back.

Texts are encoded with a tokenizers vocabulary that never joins characters across white space; each
distinct word of a slice is encoded once by the library, and words seen before come from a store of
the Python worker, bounded in words and bytes. With a vocabulary that lowers letters and never joins letters, digits
and symbols (`PARTED`), words are cut there before, so that one piece serves all the words that hold it. Each document ends with END. Documents are ordered by range partitions, whose
borders are a doc_id and how a text begins, so that rows without a doc_id, or with the same one, spread over tasks; every
partition holds frames of whole documents (see `mixing_coder`), in a table of (part, frame, n_ids, data)
in the shared folder, written by Spark's committed writer. Reading decodes all frames and checks every block.

Nulls: a null text is empty (END only); a null doc_id comes first. Repeated rows are kept; rows with the same
doc_id are ordered by text. An empty table gives an empty result. Columns other than doc_id and text are
ignored. A text of any length stays in one frame.
"""

import json
import os
import re
import sys
import types
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latchflow.llm.common import LOWER, SHORT, Slice, slices
from latchflow.llm.mixing_coder import read_frame, write_frame
from latchflow.plans.session import fresh_dir

END = 1
#: Ids after which a frame is closed. Many blocks in step share the cost of numpy's calls.
FRAME = 8_000_000
#: Words that a Python worker remembers lately; it keeps as many earlier ones.
STORE = 300_000
#: Bytes of a word that is remembered; longer ones are encoded again in every slice.
KEPT = 48
#: Characters of a text that borders between partitions hold; inside partitions whole texts are ordered.
BEGINS = 64

#: Normalizers and pattern of the vocabularies whose words are cut.
PARTED = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)
#: How their special tokens begin; slices that hold it stay as they are.
SPECIAL = "<|"
#: Kinds of bytes: letters 1, digits 2, symbols 3; next to others (0, as the apostrophe of contractions) nothing is cut.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[0x27] = 0
#: Texts of such letters only.
_LETTERS = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _worker(path: str):
    """The worker's tokenizer and known words; they outlive a task."""
    held = sys.modules.setdefault("_token_files_worker", types.ModuleType("_token_files_worker"))
    if getattr(held, "path", None) != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        held.path, held.tokenizer, held.words, held.older = path, Tokenizer.from_file(path), {}, {}
        held.parted, held.model = _parted(json.loads(held.tokenizer.to_str())), held.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # how the vocabulary spells the second bytes of letters from U+00C0 to U+017F
        held.spelt = {b: level.pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][1] for b in range(0x80, 0xC0)}
    return held


def _parted(said: dict) -> bool:
    """Whether the vocabulary is one of those whose words may be cut, and bytes 0x21 to 0x7E stay what they are."""
    before = (said["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    split = {"type": "Split", "pattern": {"Regex": PARTED[1]}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    return (
        (said["normalizer"] or {}).get("normalizers") == PARTED[0] and len(before) == 2 and before[0] == split
        and {k: before[1].get(k) for k in level} == level and said["post_processor"] is None and not said["model"].get("dropout")
        and all(t["content"].startswith(SPECIAL) and not t["normalized"] for t in said["added_tokens"])
    )


def _pieces(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and each row's first of the words, cut where letters, digits and symbols meet.

    Letters are those of ASCII, and from U+00C0 to U+017F all that NFC and lowering leave a letter of their own.
    """
    starts, ends, _ = part.words()
    data = part.data
    kind = _KIND[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))
    both = (data[lead].astype(np.int64) << 8) | data[lead + 1]
    # not the signs of times and division, nor the dotted capital I, which becomes two characters
    lead = lead[((both & 0xC0) == 0x80) & (both != 0xC397) & (both != 0xC3B7) & (both != 0xC4B0)]
    kind[lead] = kind[lead + 1] = 1
    cuts = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    borders = []
    for places in (starts, ends):
        at = np.zeros(len(data) + 1, dtype=bool)
        at[places] = at[cuts] = True
        borders.append(np.flatnonzero(at))
    return *borders, np.searchsorted(borders[0], part.offsets)


def _distinct_words(part, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different words of a slice, and the place of each word among them; longer words are told apart by their bytes."""
    data, size = part.tobytes(), ends - starts
    short = np.flatnonzero(size < SHORT)
    _, first, place = np.unique(part.hashes(starts[short], ends[short]), return_index=True, return_inverse=True)
    first = short[first]
    names = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    which = np.empty(len(starts), dtype=np.int64)
    which[short] = place
    long = np.flatnonzero(size >= SHORT)
    known: dict[bytes, int] = {}
    count = len(names)
    which[long] = [
        known.setdefault(data[a:b], count + len(known)) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)
    ]
    return names + list(known), which


def _remember(known: dict[bytes, bytes], blobs: list, names: list[bytes], i: int, ids: list[int]) -> None:
    blobs[i] = array("I", ids).tobytes()
    if len(names[i]) <= KEPT:
        known[names[i]] = blobs[i]


def encoded(text: pa.Array, path: str):
    """(ids, lengths) of runs of rows, in order; every row's ids end with END."""
    held = _worker(path)
    for part in slices(text):
        parted = held.parted and SPECIAL.encode() not in part.tobytes()
        if parted:
            part = Slice(part.first, LOWER[part.data], part.offsets)
        starts, ends, borders = _pieces(part) if parted else part.words()
        names, which = _distinct_words(part, starts, ends)
        if len(held.words) > STORE:
            held.older, held.words = held.words, {}
        known = held.words
        blobs = list(map(known.get, names))
        new = []
        for i in [i for i, b in enumerate(blobs) if b is None]:
            if (blob := held.older.get(names[i])) is not None:
                known[names[i]] = blobs[i] = blob
            elif parted and names[i].isalpha():
                # lowered letters are what the vocabulary's normalizers and pattern would pass to its model
                _remember(known, blobs, names, i, [t.id for t in held.model.tokenize(names[i].decode())])
            elif parted and _LETTERS.fullmatch(word := names[i].decode("utf-8", "replace")):
                spelt = word.lower().encode().decode("latin-1").translate(held.spelt)
                _remember(known, blobs, names, i, [t.id for t in held.model.tokenize(spelt)])
            else:
                new.append(i)
        found = held.tokenizer.encode_batch_fast([names[i].decode("utf-8", "replace") for i in new], add_special_tokens=False)
        for i, e in zip(new, found, strict=True):
            _remember(known, blobs, names, i, e.ids)
        blobs.append(array("I", [END]).tobytes())
        sizes = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // 4
        flat = np.frombuffer(b"".join(blobs), dtype=np.uint32)
        begin = np.cumsum(sizes) - sizes
        # the end of a text is one more word behind its last one
        item = np.full(len(which) + part.rows, len(names), dtype=np.int64)
        row = np.repeat(np.arange(part.rows), np.diff(borders))
        item[np.arange(len(which)) + row] = which
        many = sizes[item]
        stop = np.cumsum(many)
        ids = flat[np.repeat(begin[item] - stop + many, many) + np.arange(int(stop[-1]))]
        last = stop[borders[1:] + np.arange(part.rows)]
        yield ids, np.diff(last, prepend=0)


def write(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Write the coded frames of all documents below `folder`."""
    path = path or vocabulary()

    def tasks(batches):
        from pyspark import TaskContext

        part, frame = TaskContext.get().partitionId(), 0
        names, lengths, ids, size = [], [], [], 0

        def close():
            joined = np.concatenate(ids)
            data = write_frame(names, np.concatenate(lengths), joined)
            values = ([part], [frame], [len(joined)], [data])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["part", "frame", "n_ids", "data"]
            )

        for batch in batches:
            doc_ids, at = batch.column("doc_id").to_pylist(), 0
            for found, many in encoded(batch.column("text"), path):
                names += doc_ids[at : at + len(many)]
                at += len(many)
                lengths.append(many)
                ids.append(found)
                size += len(found)
                if size >= FRAME:
                    yield close()
                    names, lengths, ids, size, frame = [], [], [], 0, frame + 1
        if names:
            yield close()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id", F.substring("text", 1, BEGINS)).sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(tasks, "part long, frame long, n_ids long, data binary").write.parquet(folder)


def read(spark, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, part, frame."""
    frames = spark.read.parquet(folder)
    earlier = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    index = frames.select("part", "frame", "n_ids").withColumn("before", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    totals = sorted((r["part"], r["n"]) for r in frames.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases, base = [], 0
    for part, n in totals:  # one number per partition of the files
        bases.append((part, base))
        base += n
    offsets = index.join(F.broadcast(spark.createDataFrame(bases, "part long, base long")), "part").select(
        "part", "frame", (F.col("before") + F.col("base")).alias("first")
    )

    def tasks(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, frame, data = (batch.column(i)[row].as_py() for i in range(3))
                doc_ids, lengths, ids = read_frame(data)
                stop = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                start = stop - lengths
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part)), pa.array(np.full(n, frame)), pa.array(doc_ids, pa.int64()), pa.array(start),
                     pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())],
                    ["part", "frame", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = frames.select("part", "frame", "data").mapInArrow(
        tasks, "part long, frame long, doc_id long, start long, n_tokens long, ids_crc32 long"
    )
    return rows.join(offsets, ["part", "frame"]).select(
        "doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "part", "frame"
    )


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write all documents' ids to new files in the shared folder and read them back."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "tokens")
    write(docs, folder, path)
    return read(spark, folder)


def query(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
