"""Periodic runs of words by a dictionary of basic factors.

Per power-of-two length L each place of a text has a name, the same for equal factors of L words; names of 2 L are pairs
of names of L, and a factor that occurs once needs no name any more. A place whose next occurrence lies within 2 L, and
whose next one again lies as far, begins an arithmetic progression; its difference is proposed as a period. Proposals
are extended to both sides word by word and deduplicated: what is long enough is a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches, spare
from .tool_calls import let
from .words import SPACED, Piece, mix, pieces

#: Least words of a run, and least number of its periods.
LEAST, POWER = 6, 4
#: Words that an extension compares at once, to begin with and at most.
STEP, STEPS = 64, 1 << 16
_NONE = -1


def paired(names: np.ndarray, length: int) -> np.ndarray:
    """Names of factors of 2 * length from those of length; _NONE where a factor occurs once."""
    out = np.full(len(names), _NONE, np.int64)
    at = np.flatnonzero((names[: len(names) - length] != _NONE) & (names[length:] != _NONE))
    keys = names[at] * (len(names) + 1) + names[at + length]
    _, named, n = np.unique(keys, return_inverse=True, return_counts=True)
    some = n[named] > 1
    out[at[some]] = named[some]
    return out


def successors(names: np.ndarray, most: int) -> np.ndarray:
    """How far the next occurrence of each place's factor lies; 0 where none lies within `most`."""
    out = np.zeros(len(names), np.int64)
    at = np.flatnonzero(names != _NONE)
    at = at[np.argsort(names[at], kind="stable")]
    step = np.diff(at)
    near = (names[at[1:]] == names[at[:-1]]) & (step <= most)
    out[at[:-1][near]] = step[near]
    return out


def equal_ahead(words: np.ndarray, i: int, j: int) -> int:
    """How many words from i and from j > i on are equal."""
    n, step = 0, STEP
    while j + n < len(words):
        same = words[i + n : i + n + step][: len(words) - j - n] == words[j + n : j + n + step]
        if not same.all():
            return n + int(same.argmin())
        n, step = n + len(same), min(2 * step, STEPS)
    return n


def equal_behind(words: np.ndarray, i: int, j: int) -> int:
    """How many words before i and before j > i are equal."""
    n, step = 0, STEP
    while i - n > 0:
        size = min(step, i - n)
        same = (words[i - n - size : i - n] == words[j - n - size : j - n])[::-1]
        if not same.all():
            return n + int(same.argmin())
        n, step = n + size, min(2 * step, STEPS)
    return n


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of each run of words (integers, equal for equal words), sorted."""
    if not len(words):
        return []
    _, names, n = np.unique(words, return_inverse=True, return_counts=True)
    names = np.where(n[names] > 1, names, _NONE).astype(np.int64)
    found: dict[tuple[int, int], int] = {}
    seen: dict[int, list[tuple[int, int]]] = {}  # stretches by their period, in the order of their starts for each length
    length = 1
    while length <= len(words) // 2 and (names != _NONE).any():
        step = successors(names, 2 * length)
        ahead = np.minimum(np.arange(len(step)) + step, len(step) - 1)
        three = (step > 0) & (step[ahead] == step)
        first = three.copy()
        first[1:] &= ~(three[:-1] & (step[1:] == step[:-1]))
        for i in np.flatnonzero(first).tolist():
            d = int(step[i])
            if any(a <= i < b for a, b in seen.get(d, ())[-8:]):
                continue
            start = i - equal_behind(words, i, i + d)
            size = i - start + equal_ahead(words, i, i + d) + d
            seen.setdefault(d, []).append((start, start + size - d))
            if size >= max(LEAST, POWER * d):
                found[start, size] = min(d, found.get((start, size), d))
        names, length = paired(names, length), 2 * length
    return sorted((start, size, d) for (start, size), d in found.items())


def piece_runs(piece: Piece) -> dict[int, list[tuple[int, int, int]]]:
    """The runs of each text of a piece that has some. Words of different texts never count as equal."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    firsts = piece.first_words()
    for start, size, d in runs_of(piece.hashes ^ mix(piece.word_doc.astype(np.uint64) + np.uint64(1))):
        doc = int(piece.word_doc[start])
        out.setdefault(doc, []).append((start - int(firsts[doc]), size, d))
    return out


def collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> str:
    """The text's words joined by one space, without those that a run has after its first period."""
    words = text.split()
    if runs:
        gone = np.zeros(len(words), bool)
        for start, size, d in runs:
            gone[start + d : start + size] = True
        words = [words[i] for i in np.flatnonzero(~gone).tolist()]
    return b" ".join(words).decode()


def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, a text, by its number of words, its runs and its words without what they repeat."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        n, runs, texts = [], [], []
        for piece in pieces(batch.column(batch.num_columns - 1), SPACED):
            of, counts = piece_runs(piece), piece.n_words()
            for d in range(piece.docs):
                mine = of.get(d, [])
                n.append(int(counts[d]))
                runs.append([{"start": s, "length": size, "period": p} for s, size, p in mine])
                texts.append(collapsed(piece.data[piece.starts[d] : piece.starts[d + 1]].tobytes(), mine))
        cols = [pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())]
        yield pa.record_batch([*batch.columns[:-1], *cols], names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (start, length, period; sorted by start, then period), collapsed.

    Words are [^\\x20\\x09-\\x0D]+, numbered from 0. A run is a stretch of max(6, 4 * period) words or more in which words
    a period apart are identical, for the smallest such period, that no neighbouring word extends. collapsed joins by
    one space the words that no run has after its first period. Null and empty texts have no words, no runs and an empty
    collapsed text. Rows that repeat are taken one by one, doc_id may be null or repeat; very long texts are taken
    whole, in memory linear in their words. No rows give no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run_batches, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def looped_tails(docs: DataFrame) -> DataFrame:
    """docs with repetition planted in about a tenth of the texts: with h = crc32 of the decimal doc_id, g = floor(h / 10)
    and n words, where h % 10 = 0 word i >= a becomes word a + (i - a) % p, a = g % n, p = 1 + floor((n - a) / (3 + g % 8)).
    Texts without words and rows without a doc_id stay as they are."""
    hash_of, text = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.col("text").cast("string")
    g = F.floor(hash_of / 10)

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        ends = F.array(F.struct(words.alias("w"), a.cast("int").alias("a"), p.cast("int").alias("p"), n.alias("n")))
        looped = F.element_at(F.transform(ends, lambda e: F.transform(F.sequence(F.lit(0), e["n"] - 1), lambda i: F.get(e["w"], F.when(i < e["a"], i).otherwise(e["a"] + F.pmod(i - e["a"], e["p"]))))), 1)
        return F.when(n > 0, F.array_join(looped, " ")).otherwise(text)

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.withColumn("text", F.when(F.pmod(hash_of, F.lit(10)) == 0, let(words, tail)).otherwise(text))


def digests(found: DataFrame) -> DataFrame:
    """periodic_runs() with the run of the greatest exact length / period (ties: least start, then period) and hashes."""
    (top,) = spare(found, "top")
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    # runs are sorted, so the first of equals stays
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    out = found.withColumn(top, F.aggregate("runs", none, better))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col(top)["start"].alias("start"), F.col(top)["length"].alias("length"), F.col(top)["period"].alias("period"),
        F.floor(1000 * F.col(top)["length"] / F.col(top)["period"]).alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(looped_tails(read_table(spark, sf_dir, "documents"))))
