"""Aligned reads from BAM files and SAM lines, as the tables that ``operators.reads`` measures.

The formats are those of the public SAM/BAM specification. SAM lines are split among
tasks like any text; a BAM file, being one stream, is decoded by one task in batches,
and is limited to the 2 GB of a binary value. CRAM is not read: convert it first.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READS = "path string, record_no long, qname string, flag int, rname string, pos long, mapq int, cigar string, mate string, tlen long, seq string, nm long"
#: Reads of a batch.
BATCH = 10_000
# Codes of CIGAR operations and of bases, sizes of tag values.
_OPS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
_HEAD = "<iiBBHHHiiii"


def _edits(tags: bytes) -> int | None:
    """The NM tag's number."""
    at = 0
    while at + 3 <= len(tags):
        name, kind = tags[at : at + 2], chr(tags[at + 2])
        at += 3
        if name == b"NM" and kind in _NUMBERS:
            return struct.unpack_from(_NUMBERS[kind], tags, at)[0]
        if kind in "ZH":
            at = tags.index(b"\0", at) + 1
        elif kind == "B":
            at += 5 + _SIZES[chr(tags[at])] * struct.unpack_from("<i", tags, at + 1)[0]
        else:
            at += _SIZES[kind]
    return None


def decode(data: bytes, path: str = "") -> Iterator[tuple]:
    """Reads of a BAM file in the columns of READS, one at a time; a broken file is an error that names it."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data))

    def take(n: int) -> bytes:
        got = stream.read(n)
        if len(got) != n:
            raise ValueError(f"{path}: truncated")
        return got

    try:
        if take(4) != b"BAM\1":
            raise ValueError(f"{path}: no BAM file")
        take(struct.unpack("<i", take(4))[0])
        names: list[str | None] = []
        for _ in range(struct.unpack("<i", take(4))[0]):
            names.append(take(struct.unpack("<i", take(4))[0])[:-1].decode())
            take(4)
        name = lambda k: names[k] if k >= 0 else None
        number = 0
        while size := stream.read(4):
            body = take(struct.unpack("<i", size)[0])
            ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate, _, tlen = struct.unpack_from(_HEAD, body)
            at = struct.calcsize(_HEAD)
            qname = body[at : at + n_name - 1].decode()
            at += n_name
            cigar = "".join(f"{c >> 4}{_OPS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", body, at))
            at += 4 * n_cigar
            packed = body[at : at + (n_seq + 1) // 2]
            seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:n_seq]
            at += len(packed) + n_seq
            yield path, number, qname, flag, name(ref), pos, mapq, cigar or "*", name(mate), tlen, seq or "*", _edits(body[at:])
            number += 1
    except (EOFError, OSError, zlib.error, struct.error, IndexError, KeyError) as broken:
        raise ValueError(f"{path}: cannot be read as BAM: {broken}") from broken


def bam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Reads of BAM files: positions from 0, names null where there is no reference, ``*`` for no CIGAR or sequence."""
    columns = [c.split()[0] for c in READS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                held: list[tuple] = []

                def table() -> pd.DataFrame:
                    return pd.DataFrame(held, columns=columns).astype({"nm": "Int64"})  # noqa: B023

                for row in decode(bytes(content), where):
                    held.append(row)
                    if len(held) == BATCH:
                        yield table()
                        held.clear()
                if held:
                    yield table()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, READS)


def sam(lines: DataFrame) -> DataFrame:
    """Reads of SAM lines in the same columns; the record number is the line's. Fewer than eleven fields, or a number that is none, is an error on reading."""
    f = F.split("line", "\t")
    at = lambda k: F.get("f", F.lit(k))
    rows = lines.where(~F.col("line").startswith("@") & (F.trim("line") != "")).withColumn("f", f)
    bad = (F.size("f") < 11) | at(1).try_cast("int").isNull() | at(3).try_cast("long").isNull() | at(4).try_cast("int").isNull() | at(8).try_cast("long").isNull()
    where = F.concat(F.lit("no alignment at "), F.col("path"), F.lit(":"), F.col("line_no").cast("string"))
    edits = F.regexp_extract(F.element_at(F.filter(F.slice("f", 12, 1 << 20), lambda t: t.startswith("NM:i:")), 1), "^NM:i:(-?[0-9]+)$", 1)
    name = lambda c: F.when(c != "*", c)
    tags = F.when(F.exists("f", lambda t: t.startswith("NM:i:")), edits.try_cast("long"))
    return rows.select(
        "path", F.col("line_no").alias("record_no"), F.when(bad, F.raise_error(where).cast("string")).otherwise(at(0)).alias("qname"), at(1).try_cast("int").alias("flag"), name(at(2)).alias("rname"), (at(3).try_cast("long") - 1).alias("pos"), at(4).try_cast("int").alias("mapq"),
        at(5).alias("cigar"), F.when(at(6) == "=", name(at(2))).otherwise(name(at(6))).alias("mate"), at(8).try_cast("long").alias("tlen"), at(9).alias("seq"), tags.alias("nm"),
    )


def encode(references: Mapping[str, int], reads: Sequence[Mapping]) -> bytes:
    """A small BAM file of reads with the columns of READS."""
    names = list(references)
    number = lambda n: names.index(n) if n is not None else -1
    out = [b"BAM\1", struct.pack("<ii", 0, len(names))]
    for n in names:
        out.append(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", references[n]))
    for r in reads:
        seq = "" if r["seq"] == "*" else r["seq"]
        text = "" if r["cigar"] == "*" else r["cigar"]
        ops, digits = [], ""
        for c in text:
            if c.isdigit():
                digits += c
            else:
                ops.append(int(digits) << 4 | _OPS.index(c))
                digits = ""
        codes = [_BASES.index(b) for b in seq] + [0] * (len(seq) % 2)
        body = struct.pack(_HEAD, number(r["rname"]), r["pos"], len(r["qname"]) + 1, r["mapq"], 0, len(ops), r["flag"], len(seq), number(r["mate"]), -1, r["tlen"])
        body += r["qname"].encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + b"\xff" * len(seq)
        body += b"XSZtext\0XBBs\2\0\0\0\1\0\2\0" + (b"" if r["nm"] is None else b"NMi" + struct.pack("<i", r["nm"]))
        out.append(struct.pack("<i", len(body)) + body)
    return gzip.compress(b"".join(out))
