"""Exact deduplication by deterministic block naming, in DataFrame functions only.

Normalised texts are cut into blocks of a fixed number of bytes. Distinct blocks are sorted and
numbered; the number is a block's name. Then neighbouring names are paired, distinct pairs are
sorted and numbered in turn, and so on, until each text is one name. Two texts of as many levels
have the same name exactly if they are identical: names come from comparing blocks and pairs
themselves, never from trusting a hash.

The text is shuffled once, to find the distinct blocks (after each map task has dropped its own
copies). Names travel back by a 64-bit fingerprint of the block. Fingerprints that two different
blocks share are found while numbering, and those blocks alone are matched by content.

Defined results: a null text counts as empty, all empty texts are one group; a null id sorts last;
of repeated rows (same id, equal text) one stays; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import SPACE_RE, Workspace, fresh, text_of

#: Stands for the missing right half of an odd row of names.
NO_NAME = -(2**63)


def normalised(df: DataFrame, text: str = "text") -> Column:
    """Each stretch of white space as one space."""
    return F.regexp_replace(text_of(df, text), SPACE_RE, " ")


def _blocks(df: DataFrame, id_col: str, text_col: str, size: int, fingerprint) -> DataFrame:
    """A row for each block: id, sha, n (blocks of the text), pos, block, fp."""
    rows = df.select(df[id_col].alias("id"), normalised(df, text_col).cast("binary").alias("body"))
    rows = rows.select("id", "body", F.sha2("body", 256).alias("sha"), F.greatest(F.lit(1), F.ceil(F.octet_length("body") / size)).cast("int").alias("n"))
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    block = F.expr(f"substring(body, pos * {int(size)} + 1, {int(size)})")
    return rows.select("id", "sha", "n", "pos", block.alias("block")).withColumn("fp", fingerprint(F.col("block")))


def _numbered(distinct: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Distinct keys, sorted in their partition and numbered: partition, then place in it."""
    return distinct.sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())


def identities(df: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8192, fingerprint=F.xxhash64) -> DataFrame:
    """``row, id, sha, level, name``: rows with the same ``level`` and ``name`` have equal normalised texts.

    ``fingerprint`` only routes names; a weak one costs time, never a wrong result.
    """
    blocks = _blocks(df, id_col, text_col, block_bytes, fingerprint)
    # a text's blocks follow one another, so this is one number for each input row, repeated rows included
    rows = ws.keep(blocks.drop("block").withColumn("row", F.monotonically_increasing_id() - F.col("pos")), "rows")
    names = ws.keep(_numbered(blocks.select("fp", "block").distinct(), ["fp", "block"]).select("fp", "name"), "names")
    shared = names.groupBy("fp").agg(F.count("*").alias("c")).filter("c > 1").select("fp")
    if shared.head(1):
        named = _named_by_content(rows, names, ws.keep(shared, "shared"), blocks, ws)
    else:
        named = rows.join(names, "fp")
    level, table = 0, ws.keep(named.select("id", "sha", "n", "pos", "row", "name"), "level0")
    most = table.agg(F.max("n")).head()[0] or 1
    done = []
    while True:
        done.append(table.filter("n = 1").select("row", "id", "sha", F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        level, most = level + 1, -(-most // 2)
        table = ws.keep(_paired(table.filter("n > 1")), f"level{level}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _paired(table: DataFrame) -> DataFrame:
    """Names of neighbours become one name."""
    even = F.col("pos") % 2 == 0
    pairs = (
        table.groupBy("row", "id", "sha", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos"))
        .agg(F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(NO_NAME)).alias("right"))
    )
    names = _numbered(pairs.select("left", "right").distinct(), ["left", "right"])
    return pairs.join(names, ["left", "right"]).select("id", "sha", "n", "pos", "row", "name")


def _named_by_content(rows: DataFrame, names: DataFrame, shared: DataFrame, blocks: DataFrame, ws: Workspace) -> DataFrame:
    """Names where some fingerprints stand for several blocks: those blocks get negative names by content."""
    some = blocks.join(shared, "fp", "left_semi")
    own = ws.keep(_numbered(some.select("fp", "block").distinct(), ["fp", "block"]).withColumn("name", -1 - F.col("name")), "own")
    placed = some.join(own, ["fp", "block"]).select(F.col("id").alias("id2"), F.col("sha").alias("sha2"), F.col("pos").alias("pos2"), "name").distinct()
    plain = rows.join(shared, "fp", "left_anti").join(names, "fp")
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("sha") == F.col("sha2")) & (F.col("pos") == F.col("pos2"))
    return plain.unionByName(rows.join(shared, "fp", "left_semi").join(placed, same).drop("id2", "sha2", "pos2"))


def exact_groups(df: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8192, fingerprint=F.xxhash64) -> DataFrame:
    """A row for each input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = identities(df, ws, id_col, text_col, block_bytes, fingerprint)
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    groups = rows.groupBy("level", "name").agg(F.min(first).alias("first"), F.count("*").alias("group_size"))
    out = rows.join(groups, ["level", "name"])
    return out.select(F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(df: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, whole."""
    k, sha = fresh(df, "_k", "_sha")
    kept = exact_groups(df, ws, id_col, text_col).filter("kept").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(k), F.col("text_sha256").alias(sha))
    marked = df.withColumns({k: F.coalesce(df[id_col].cast("string"), F.lit("")), sha: F.sha2(normalised(df, text_col), 256)})
    return marked.join(kept, [k, sha], "left_semi").dropDuplicates([k, sha]).select(*df.columns)
