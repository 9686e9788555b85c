"""Sources: strict and lenient tables, JSON lines, wrapped JSON, keyed look-ups, documents of blocks."""

from __future__ import annotations

import codecs
import csv
import io
import json
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, without a byte-order mark."""
    first = spark.read.text(path).head()
    if first is None:
        raise ValueError(f"{path} has no header")
    names = [c.strip() for c in next(csv.reader([first[0].lstrip("\ufeff")]))]
    if len(set(names)) != len(names):
        raise ValueError(f"{path} repeats column names")
    return names


def strict_csv(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """All columns as text; rows that are too short or too long fail when they are read."""
    names = header_of(spark, path)
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=True)
    checked = F.when(F.col(CORRUPT).isNotNull(), F.raise_error(F.concat(F.lit("a row has the wrong number of fields: "), F.col(CORRUPT)))).otherwise(F.col(names[0]))
    return rows.select(checked.cast("string").alias(names[0]), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in names[1:]])


def index_csv(spark: SparkSession, path: str, keys: Sequence[str] = ("itemid", "case_id")) -> DataFrame:
    """A table with very long fields and one of the ``keys``, under the first one's name."""
    names = header_of(spark, path)
    found = [k for k in keys if k in names]
    if not found:
        raise ValueError(f"{path} has none of {list(keys)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', maxCharsPerColumn=-1)
    return rows.withColumn(keys[0], F.coalesce(*[F.nullif(F.trim(F.col(k)), F.lit("")) for k in found]))


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object a line; anything else fails."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def wrapped_json(spark: SparkSession, path: str, wrappers: Sequence[str] = ("predictions", "targets", "rows", "data")) -> DataFrame:
    """A JSON list, or the list under the first wrapper there is."""
    rows = spark.read.option("multiLine", True).json(path)
    found = [w for w in wrappers if w in rows.columns and isinstance(rows.schema[w].dataType, T.ArrayType)]
    return rows.select(F.inline(F.col(found[0]))) if found else rows


def records(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: CSV, JSON lines or JSON."""
    kinds = {"csv": strict_csv, "jsonl": json_lines, "json": wrapped_json}
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in kinds:
        raise ValueError(f"no reader for .{suffix}")
    return kinds[suffix](spark, path)


def look_up(ids: DataFrame, store: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Rows of the store by id, and from the fallback those that it lacks."""
    wanted = ids.select(key).distinct()
    missing = wanted.join(store.select(key), key, "left_anti")
    return store.join(wanted, key, "left_semi").unionByName(fallback.join(missing, key, "left_semi"), allowMissingColumns=True)


def exactly_one(df: DataFrame, key: str, value: object) -> DataFrame:
    """The one row with the id; none or several are an error when the plan runs."""
    found = df.filter(F.col(key) == F.lit(value)).agg(F.count("*").alias("n"), F.first(F.struct(*df.columns)).alias("row"))
    checked = F.when(F.col("n") == 1, F.col("row")).otherwise(F.raise_error(F.concat(F.lit(f"not exactly one row with {key} {value}: "), F.col("n").cast("string"))).cast(found.schema["row"].dataType))
    return found.select(checked.alias("row")).select("row.*")


def sidecar(df: DataFrame, key: str, order: str, multi: bool) -> DataFrame:
    """By id: the last row in input order, or all rows as a list in that order."""
    row = F.struct(*df.columns)
    if multi:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), row.alias("row"))))
        return df.groupBy(key).agg(F.transform(pairs, lambda p: p["row"]).alias("rows"))
    return df.groupBy(key).agg(F.max_by(row, order).alias("row")).select("row.*")


#: Fixed names of the word-processing format.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(payload: bytes, marker: str = "APPENDIX") -> list[tuple[int, str, str, bool]]:
    """Blocks of a document in order: number, kind (paragraph, table or other), text, and whether an appendix has begun."""
    with zipfile.ZipFile(io.BytesIO(payload)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out, after = [], False
    for i, node in enumerate(body if body is not None else []):
        if node.tag == f"{_W}tbl":
            kind, value = "table", "\n".join(" | ".join(text(c) for c in row.iter(f"{_W}tc")) for row in node.iter(f"{_W}tr"))
        else:
            kind, value = ("paragraph" if node.tag == f"{_W}p" else "other"), text(node)
        after = after or (kind == "paragraph" and value.strip().upper().startswith(marker))
        out.append((i, kind, value, after))
    return out


def docx(spark: SparkSession, path: str) -> DataFrame:
    """``path, block, kind, text, in_appendix`` of all documents under a path."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, content in zip(rows["path"], rows["content"], strict=True):
                blocks = docx_blocks(content)
                yield pd.DataFrame([(name, *b) for b in blocks], columns=["path", "block", "kind", "text", "in_appendix"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, block int, kind string, text string, in_appendix boolean")


def inferred_csv(spark: SparkSession, path: str, missing: Sequence[str] = ("", "NA", "NaN", "nan", "null", "None")) -> DataFrame:
    """Columns with the type that all their values have: whole numbers, numbers, booleans, else text; missing marks are null."""
    rows = strict_csv(spark, path)
    blank = {c: F.when(~F.trim(c).isin(*missing), F.trim(c)) for c in rows.columns}
    kinds = (("long", "bigint"), ("double", "double"), ("boolean", "boolean"))
    fits = rows.agg(*[F.bool_and(v.isNull() | v.try_cast(kind).isNotNull()).alias(f"{i}_{k}") for i, v in enumerate(blank.values()) for k, (_, kind) in enumerate(kinds)], *[F.count(v).alias(f"{i}_n") for i, v in enumerate(blank.values())]).head()
    out = []
    for i, (c, v) in enumerate(blank.items()):
        kind = next((kind for k, (_, kind) in enumerate(kinds) if fits[f"{i}_n"] and fits[f"{i}_{k}"]), None)
        out.append((v.try_cast(kind) if kind else v).alias(c))
    return rows.select(*out)


def json_items(stream, piece: int = 1 << 20) -> Iterator[object]:
    """The members of one large JSON array, read a piece at a time; whole objects are never held together."""
    decoder, text, held, at, begun = codecs.getincrementaldecoder("utf-8")(), json.JSONDecoder(), "", 0, False
    while True:
        data = stream.read(piece)
        held, at = held[at:] + decoder.decode(data, not data), 0
        while True:
            while at < len(held) and held[at] in " \t\r\n,\ufeff":
                at += 1
            if at == len(held):
                break
            if not begun:
                if held[at] != "[":
                    raise ValueError("the file is no JSON array")
                begun, at = True, at + 1
                continue
            if held[at] == "]":
                return
            try:
                value, end = text.raw_decode(held, at)
            except ValueError:
                break  # the rest is in the next piece
            if end == len(held) and data and not isinstance(value, dict | list | str):
                break  # a number may go on
            yield value
            at = end
        if not data:
            raise ValueError("the array does not end")


def json_array(spark: SparkSession, path: str, key: str = "itemid", wanted: Sequence[str] | None = None) -> DataFrame:
    """``key, record`` (JSON text) of files that hold one large JSON array each; with ``wanted`` reading stops once all are found.

    One task reads a file in pieces through the file system that its path names; records leave it in small batches.
    """
    wanted = set(map(str, wanted)) if wanted is not None else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for rows in batches:
            for name in rows["path"]:
                left = set(wanted) if wanted is not None else None
                system, inner = fs.FileSystem.from_uri(name)
                with system.open_input_stream(inner) as stream:
                    held: list[tuple] = []
                    for item in json_items(stream):
                        own = str(item.get(key)) if isinstance(item, dict) and item.get(key) is not None else None
                        if left is not None and own not in left:
                            continue
                        held.append((own, json.dumps(item, ensure_ascii=False, sort_keys=True)))
                        if left is not None:
                            left.discard(own)
                        if len(held) >= 500:
                            yield pd.DataFrame(held, columns=[key, "record"])
                            held = []
                        if left is not None and not left:
                            break
                    yield pd.DataFrame(held, columns=[key, "record"])

    files = spark.read.format("binaryFile").load(path).select("path")  # names only: contents are not loaded
    return files.mapInPandas(read, f"{key} string, record string")


def split_members(spark: SparkSession, path: str, split: str, key: str = "itemid") -> DataFrame:
    """``key, place`` of a split's members in their order: from JSON (``{split: [ids]}`` or a list) or a CSV with a split column; repeats stop the plan."""
    if path.endswith(".csv"):
        rows = strict_csv(spark, path, [key, "split"]).withColumn("place", F.monotonically_increasing_id()).filter(F.col("split") == split).select(key, "place")
    else:
        whole = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))  # a list of ids, of the size of a split
        ids = whole.get(split) if isinstance(whole, dict) else whole
        if not isinstance(ids, list):
            raise ValueError(f"{path} has no list for {split}")
        rows = spark.createDataFrame([(str(x), i) for i, x in enumerate(ids)], f"{key} string, place long")
    counts = rows.groupBy(key).agg(F.min("place").alias("place"), F.count("*").alias("n"))
    return counts.select(key, F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated member: "), F.col(key))).cast("long")).otherwise(F.col("place")).alias("place"))


def release_root(path: str | None, version: str, known: Sequence[str] = ("corrected",)) -> str:
    """The folder of a release: named explicitly, never searched for; an unknown version is an error."""
    if not path:
        raise ValueError("name the release's folder")
    if version not in known:
        raise ValueError(f"unknown version {version}, known: {list(known)}")
    return path.rstrip("/")


def knowledge_base(spark: SparkSession, root: str) -> DataFrame:
    """``module, text, allowed_modes, leakage_tier`` of the modules that ``index.json`` under ``root`` lists, with their files' texts."""
    index = spark.read.option("multiLine", True).schema("modules array<struct<module_id:string,path:string,allowed_modes:array<string>,leakage_tier:string>>").json(f"{root}/index.json").select(F.inline("modules"))
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True).withColumn("file", F.input_file_name())
    return index.join(files, F.endswith("file", F.concat(F.lit("/"), F.col("path"))), "left").select(F.col("module_id").alias("module"), F.col("value").alias("text"), "allowed_modes", "leakage_tier")
