"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.session import kept, shared_dir, ship

#: The six ASCII white-space characters of the word pattern ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits at exactly these.
SPACE = " \t\n\x0b\x0c\r"
#: The same class as a Java regular expression.
SPACE_RE = r"[\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Batches sent to Python hold this many rows at most, unless the session says otherwise: texts can be long."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Workspace:
    """A folder under the shared one for the tables that one operator run writes and rereads.

    A written table cuts the lineage: what follows reads files that outlive any executor.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return it reread; the write's own shuffle files go as soon as it is done."""
        return kept(df, f"{self.path}/{name}")

    def keep_parts(self, parts: list[DataFrame], name: str) -> DataFrame:
        """Write tables of one schema one after another, each without the shuffle files of those before, and return their rows reread."""
        paths = []
        for k, part in enumerate(parts):
            self.keep(part, f"{name}/{k}")
            paths.append(f"{self.path}/{name}/{k}")
        return self.spark.read.schema(parts[0].schema).parquet(*paths)

    def drop(self, name: str | None = None) -> None:
        """Delete the folder, or one table that is not read any more, on whatever file system it is."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def in_fold(doc_id: str | Column, remainder: int, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves ``remainder`` (a null id counts as the text 'null')."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("null")).cast("binary")) % folds == remainder


def portions(texts: list[bytes], most: int = 1 << 20) -> Iterator[slice]:
    """Slices of a batch holding about ``most`` bytes each (one text at least), to bound what vectorised code holds."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield slice(start, i)
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums, one longer than the input."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ragged_take(values: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the rows ``codes`` of a ragged array; also their lengths."""
    lengths = (starts[1:] - starts[:-1])[codes]
    at = starts_of(lengths)
    index = np.arange(at[-1]) + np.repeat(starts[:-1][codes] - at[:-1], lengths)
    return values[index], lengths


def sum_by_row(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over consecutive stretches; empty stretches give 0."""
    total = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64))
    np.cumsum(values, out=total[1:])
    at = starts_of(lengths)
    return total[at[1:]] - total[at[:-1]]


def numbered(words: list) -> tuple[np.ndarray, list]:
    """Each word's number and the distinct words, in order of first appearance."""
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(place.__getitem__, words), np.int64, len(words)), list(place)
