"""Projections, gates and packets made from records: by name, by lineage, by visibility."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions.normalize import country, strip

#: Fixed names: splits as written, and columns that are never inputs.
SPLIT_ALIASES = {"train": "train", "training": "train", "val": "validation", "valid": "validation", "validation": "validation", "dev": "validation", "test": "test"}
IDENTITY = ("itemid", "case_id", "split", "test_view", "test_challenging_view", "hudoc_url")
BLOCKED_PROVENANCE = ("perapp_unique_beneficiary_category_count", "perapp_has_joint_beneficiary_category_flag")
SOURCE_GROUPS = ("metadata", "facts", "merits", "external_covariate")
#: Fixed fragments: names that give an outcome away.
OUTCOME_FRAGMENTS = ("award", "amount", "claim", "article_41", "article41", "operative", "label_source", "non_pec", "y_")


def split_name(c: Column) -> Column:
    """A split by any of its names; an unknown one stops the plan."""
    x = F.lower(strip(c))
    known = F.create_map(*[F.lit(v) for pair in SPLIT_ALIASES.items() for v in pair])
    return F.coalesce(F.element_at(known, x), F.raise_error(F.concat(F.lit("unknown split: "), F.coalesce(c, F.lit("null")))).cast("string"))


def group_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of the columns that there are, in the given order."""
    return df.select(*[c for c in columns if c in df.columns])


def kept_by_name(df: DataFrame, names: Sequence[str], prefixes: Sequence[str] = ()) -> DataFrame:
    """Columns named exactly so or by a prefix, as text, null as empty."""
    keep = [c for c in df.columns if c in names or any(c.startswith(p) for p in prefixes)]
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in keep])


def without_fragments(df: DataFrame, fragments: Sequence[str] = OUTCOME_FRAGMENTS, key: str = "case_id") -> DataFrame:
    """``key`` and a map of the values that may be seen: columns whose name holds a fragment and empty values are left out."""
    seen = [c for c in df.columns if c != key and not any(f in c.lower() for f in fragments)]
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in seen])
    full = F.filter(pairs, lambda p: p["v"].isNotNull() & (strip(p["v"]) != ""))
    return df.select(key, F.map_from_entries(full).alias("features"))


def reject_names(columns: Sequence[str], fragments: Sequence[str] = OUTCOME_FRAGMENTS) -> None:
    """An error at plan time if a name holds a fragment."""
    bad = sorted(c for c in columns if any(f in c.lower() for f in fragments))
    if bad:
        raise ValueError(f"forbidden columns: {bad}")


def feature_frame(df: DataFrame, categories: Sequence[str], numbers: Sequence[str], key: str = "case_id") -> DataFrame:
    """Categories as text, numbers as doubles with ``unknown`` as null; text that is none, negative and infinite values stop the plan."""
    out = [F.col(key)] + [F.col(c).cast("string").alias(c) for c in categories]
    for c in numbers:
        text = strip(F.col(c).cast("string"))
        value = F.when(F.lower(text).isin("unknown", ""), F.lit(None).cast("double")).otherwise(text.try_cast("double"))
        known = text.isNotNull() & ~F.lower(text).isin("unknown", "")
        bad = known & (value.isNull() | F.isnan(value) | (value < 0) | (value == float("inf")))
        out.append(F.when(bad, F.raise_error(F.concat(F.lit(f"{c} is not a number of zero or more: "), text)).cast("double")).otherwise(value).alias(c))
    return df.select(*out)


def covariates(cases: DataFrame, external: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """Allowed columns of an external table for every case; a case without them, or a row without a case, stops the plan."""
    extra = [c for c in external.columns if c != key and c not in allowed]
    if extra:
        raise ValueError(f"columns not allowed: {extra}")
    a, b = cases.select(F.col(key).alias("_a")).distinct(), external.select(F.col(key).alias("_b"), *allowed)
    joined = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    gap = F.when(F.col("_a").isNull(), F.raise_error(F.concat(F.lit("no case for "), F.col("_b").cast("string")))).when(F.col("_b").isNull(), F.raise_error(F.concat(F.lit("no covariates for "), F.col("_a").cast("string"))))
    return joined.select(F.coalesce(gap.cast(cases.schema[key].dataType), F.col("_a")).alias(key), *allowed)


def serialised(df: DataFrame, key: str, drop: Sequence[str] = IDENTITY) -> DataFrame:
    """``key, record``: the other columns as JSON with sorted names, identity left out."""
    names = sorted(c for c in df.columns if c != key and c not in drop)
    return df.select(key, F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("record"))


def messages(values: dict[str, Column], system: str, user: str) -> Column:
    """``array<struct<role, content>>`` of two templates with named slots ``{name}``; a slot without a value is an error."""
    import re

    missing = {s for t in (system, user) for s in re.findall(r"\{(\w+)\}", t)} - values.keys()
    if missing:
        raise ValueError(f"no values for {sorted(missing)}")

    def filled(template: str) -> Column:
        out = F.lit(template)
        for name, value in values.items():
            out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
        return out

    return F.array(*[F.struct(F.lit(role).alias("role"), filled(t).alias("content")) for role, t in (("system", system), ("user", user))])


def feature_schema(df: DataFrame, groups: dict[str, str]) -> DataFrame:
    """``position, name, kind, source_group`` of a feature table's columns: its public description."""
    kinds = {f.name: "number" if isinstance(f.dataType, T.NumericType) else "category" for f in df.schema}
    rows = [(i, c, kinds[c], groups.get(c)) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, kind string, source_group string")


def profile_problems(profile: dict) -> list[str]:
    """What is wrong with a feature profile: its columns, their lineage, and what it may claim."""
    columns, out = profile.get("columns") or [], []
    lineage = profile.get("lineage") or {}
    if not columns or any(not isinstance(c, str) for c in columns):
        out.append("columns")
    if len(set(columns)) != len(columns):
        out.append("duplicate columns")
    out += [f"forbidden: {c}" for c in columns if c in IDENTITY or c in BLOCKED_PROVENANCE]
    if not set(profile.get("categorical_columns") or []) <= set(columns):
        out.append("categorical columns")
    for c in columns:
        record = lineage.get(c) or {}
        if record.get("source_group") not in SOURCE_GROUPS or not record.get("source_reference"):
            out.append(f"lineage: {c}")
        elif profile.get("profile") == "metadata_knn" and record["source_group"] != "metadata":
            out.append(f"not metadata: {c}")
    return out + (["historical reproduction"] if profile.get("historical_reproduction") else [])


def reviewed_facts(rows: DataFrame, wanted: DataFrame, key: str = "case_id") -> DataFrame:
    """``key, problem`` of facts that may not be used: not accepted, without hash, anchor or text, repeated, missing or not asked for."""
    checks = {
        "not_accepted": F.col("review_status") != "accepted_prediction_input", "no_hash": ~F.col("source_document_sha256").rlike(r"^[0-9a-fA-F]{64}$"), "no_anchor": strip(F.col("source_anchor")) == "", "no_text": strip(F.col("facts_text")) == "",
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in checks.items()]))
    bad = rows.select(key, F.explode(found).alias("problem"))
    bad = bad.unionByName(rows.groupBy(key).count().filter("count > 1").select(key, F.lit("repeated").alias("problem")))
    bad = bad.unionByName(wanted.select(key).distinct().join(rows.select(key), key, "left_anti").withColumn("problem", F.lit("missing")))
    return bad.unionByName(rows.select(key).distinct().join(wanted.select(key), key, "left_anti").withColumn("problem", F.lit("not_asked_for")))


def module_gate(modules: DataFrame, mode: str, tiers: dict[str, Sequence[str]]) -> DataFrame:
    """``module, allowed, reason`` for a mode: the module's own list of modes, then its leakage tier (none counts as strictly safe)."""
    if mode not in tiers:
        raise ValueError(f"unknown mode {mode}")
    tier = F.coalesce("leakage_tier", F.lit("strict_safe"))
    reason = F.when(~F.array_contains("allowed_modes", mode), "mode").when(~tier.isin(*tiers[mode]), "leakage_tier")
    return modules.select("module", reason.isNull().alias("allowed"), reason.alias("reason"))


def typed_list(c: Column) -> tuple[Column, Column]:
    """List metadata as a list, and whether it was none: JSON lists are read, other text is split at ``;``, broken JSON is refused."""
    x = strip(c)
    blank = x.isNull() | F.lower(x).isin("", "null", "none", "nan", "n/a")
    parsed = F.from_json(x, "array<string>")
    parts = F.filter(F.transform(F.split(x, ";"), strip), lambda p: p != "")
    looks = x.rlike(r"^[\[{]")
    value = F.when(blank, F.lit(None)).when(looks, parsed).otherwise(parts)
    return value, ~blank & looks & parsed.isNull()


def normalised_metadata(df: DataFrame, lists: Sequence[str], findings: str | None = None) -> DataFrame:
    """Lists as lists; typed findings as an array of ``type, article``, with the raw text kept in ``raw_findings`` where it is none; ``issues`` names both."""
    out, issues = df, []
    for c in lists:
        value, broken = typed_list(F.col(c))
        out = out.withColumn(f"_{c}", value)
        issues.append(F.when(broken, F.lit(f"{c}: invalid list")))
    if findings:
        x = strip(F.col(findings))
        read = F.from_json(x, "array<struct<type:string,article:string>>")
        ok = read.isNotNull() & F.forall(F.coalesce(read, F.array().cast("array<struct<type:string,article:string>>")), lambda f: F.coalesce(f["type"], F.lit("")) != "")
        out = out.withColumn("raw_findings", F.when((F.coalesce(x, F.lit("")) != "") & ~F.coalesce(ok, F.lit(False)), F.col(findings))).withColumn("_findings", F.when(ok, read))
        issues.append(F.when(F.col("raw_findings").isNotNull(), F.lit(f"{findings}: not a list of typed findings")))
    out = out.withColumn("issues", F.array_compact(F.array(*issues)))
    for c in lists:
        out = out.withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return out.withColumn(findings, F.col("_findings")).drop("_findings") if findings else out


def sanitised(value: Column, blocked: Sequence[str]) -> Column:
    """A JSON text without the keys that hold a blocked fragment, at any depth: ``struct<value, removed>``, removed paths in order."""
    low = tuple(b.lower() for b in blocked)

    def clean(x: object, path: str, removed: list[str]) -> object:
        if isinstance(x, dict):
            out = {}
            for k, v in x.items():
                at = f"{path}.{k}" if path else k
                if any(b in k.lower() for b in low):
                    removed.append(at)
                else:
                    out[k] = clean(v, at, removed)
            return out
        return [clean(v, f"{path}[{i}]", removed) for i, v in enumerate(x)] if isinstance(x, list) else x

    @F.pandas_udf("value string, removed array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            removed: list[str] = []
            try:
                rows.append((json.dumps(clean(json.loads(t), "", removed), sort_keys=True, ensure_ascii=False), removed))
            except (TypeError, ValueError):
                rows.append((None, []))
        return pd.DataFrame(rows, columns=["value", "removed"])

    return run(value)


def schema_errors(value: object, schema: dict, path: str = "$") -> list[str]:
    """Where a value breaks a JSON schema: type, required and further properties, enumeration, items, bounds."""
    kinds = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}
    allowed = schema.get("type", [])
    allowed = [allowed] if isinstance(allowed, str) else allowed
    fits = [k for k in allowed if isinstance(value, kinds[k]) and not (isinstance(value, bool) and k in ("number", "integer"))]
    if allowed and not fits:
        return [f"{path}: not {' or '.join(allowed)}"]
    out = [f"{path}: not one of {schema['enum']}"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: required" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{path}.{k}: not known" for k in value if k not in known]
        for k, rule in known.items():
            if k in value:
                out += schema_errors(value[k], rule, f"{path}.{k}")
    elif isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            out += schema_errors(item, schema["items"], f"{path}[{i}]")
    elif isinstance(value, int | float) and not isinstance(value, bool):
        out += [f"{path}: below {schema['minimum']}"] if "minimum" in schema and value < schema["minimum"] else []
        out += [f"{path}: above {schema['maximum']}"] if "maximum" in schema and value > schema["maximum"] else []
    return out


def json_problems(c: Column, schema: dict) -> Column:
    """``array<string>`` of what is wrong with a JSON text; broken JSON is one problem."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(schema_errors(json.loads(t), schema))
            except (TypeError, ValueError):
                out.append(["$: not JSON"])
        return pd.Series(out, dtype=object)

    return run(c)


def truth(c: Column) -> Column:
    """Yes and no as models write them; null for anything else."""
    x = F.lower(strip(c.cast("string")))
    return F.when(x.isin("true", "yes", "1", "y"), True).when(x.isin("false", "no", "0", "n"), False)


def string_list(c: Column) -> Column:
    """A list of texts however it was written: a JSON list, or one text; blanks and repeats dropped."""
    x = strip(c)
    items = F.when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(x))
    return F.array_distinct(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), strip), lambda v: F.coalesce(v, F.lit("")) != ""))


def first_value(flat: DataFrame, key: str, terms: Sequence[str]) -> DataFrame:
    """``key, path, value``: of ``flat`` (key, path, value) the first path, by the order of the terms and then of paths, that holds a term."""
    turn = F.coalesce(*[F.when(F.contains(F.lower("path"), F.lit(t.lower())), F.lit(i)) for i, t in enumerate(terms)])
    return flat.withColumn("_t", turn).filter("_t is not null").groupBy(key).agg(F.min(F.struct("_t", "path", "value")).alias("_f")).select(key, "_f.path", "_f.value")


def best_head(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Of several readings of an award head the one that says most: granted, in another currency, with an original amount, in euros; the first of equals."""
    flag = lambda c: c.cast("int")
    score = F.struct(
        flag(F.coalesce("granted", F.lit(False))), flag(F.coalesce(F.col("original_currency") != "EUR", F.lit(False))), flag(F.col("original_amount").isNotNull()), flag(F.col("eur_amount").isNotNull()), (-F.col(order)).alias("o"),
    )
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), score).alias("_b")).select(*by, "_b.*")


def path_query(flat: DataFrame, key: str, terms: Sequence[str], most: int) -> DataFrame:
    """Rows of ``flat`` (key, path, value) asked for by a path's beginning or any part of it, sorted, up to a number of characters a key."""
    from casewright.operators.controller import within_budget

    x = F.lower("path")
    wanted = F.lit(False)
    for t in terms:
        wanted = wanted | x.startswith(t.lower()) | F.contains(x, F.lit(t.lower()))
    return within_budget(flat.filter(wanted), [key], ["path"], "value", most)


def states(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """One row a case with a struct column for each part (null where a case has none): the state that a controller works on."""
    out = None
    for name, df in parts.items():
        one = df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))
        out = one if out is None else out.join(one, key, "left")
    return out


def route_state(cases: DataFrame, mode: str, key: str = "case_id") -> DataFrame:
    """What decides a case's route through the modules: mode, articles, limb (of article 6 only), formation, importance and country."""
    from casewright.functions import extract as E

    limb = F.when(F.array_contains("articles", "6"), E.limb(F.coalesce("facts", F.lit(""))))
    return cases.select(
        key, F.lit(mode).alias("mode"), F.array_sort(F.array_distinct("articles")).alias("articles"), limb.alias("limb"), F.coalesce(limb == "ambiguous", F.lit(False)).alias("limb_ambiguous"), E.formation(F.col("branch")).alias("formation"),
        F.col("importance").try_cast("int").alias("importance"), country(F.col("country")).alias("country"),
    )


def packets(cases: DataFrame, visibility: dict[str, Sequence[str]], mode: str, key: str = "case_id") -> DataFrame:
    """``key, packet, n_fields``: the fields that a mode may see as JSON with sorted names; fields not listed, and names that give the outcome away, never are."""
    if mode not in visibility:
        raise ValueError(f"unknown mode {mode}")
    seen = sorted(c for c in visibility[mode] if c in cases.columns and c != key)
    reject_names(seen)
    return cases.select(key, F.to_json(F.struct(*seen)).alias("packet"), sum(((F.coalesce(strip(F.col(c).cast("string")), F.lit("")) != "").cast("int") for c in seen), F.lit(0)).alias("n_fields"))


def result_rows(results: DataFrame, key: str, schema: str, lists: Sequence[str] = (), flags: Sequence[str] = ()) -> DataFrame:
    """Results of a model (``key, result`` as JSON text) as typed rows: lists and flags however they were written; ``problem`` names broken ones."""
    read = F.from_json("result", schema)
    out = results.select(key, read.alias("r"), F.when(F.col("result").isNull() | F.from_json("result", "map<string,string>").isNull(), "not_an_object").alias("problem"))
    fields = [f for f in results.sparkSession.createDataFrame([], schema).columns]
    pick = [string_list(F.col(f"r.{c}")).alias(c) if c in lists else truth(F.col(f"r.{c}")).alias(c) if c in flags else F.col(f"r.{c}").alias(c) for c in fields]
    return out.select(key, *pick, "problem")
