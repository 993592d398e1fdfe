"""Data-quality checks. Nothing checked is a warning, never a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ["FAIL", "WARN", "OK"]


def header_parity(columns: list[str], expected: list[str]) -> dict[str, list[str] | bool]:
    """Ordered equality, and what either side lacks."""
    return {"equal": columns == expected, "missing": [c for c in expected if c not in columns], "unexpected": [c for c in columns if c not in expected]}


def require_header(df: DataFrame, expected: list[str]) -> DataFrame:
    got = header_parity(df.columns, expected)
    if not got["equal"]:
        raise ValueError(f"SCHEMA MISMATCH: missing {got['missing']}, unexpected {got['unexpected']}, order {df.columns}")
    return df


def shifted(df: DataFrame, column: str, prefix: str, needs: str = ",") -> DataFrame:
    """Rows whose column starts with prefix but lacks what it must hold: an unquoted separator has shifted them."""
    return df.filter(F.lower(F.col(column)).startswith(prefix) & ~F.col(column).contains(needs))


def constraints(df: DataFrame, predicates: dict[str, tuple[Column, int | Column]]) -> DataFrame:
    """name, expected, got, status for named predicates with expected counts (numbers, or aggregates of df), counted in one pass."""
    counts = df.agg(*(F.count_if(p).alias(f"c{i}") for i, (p, _) in enumerate(predicates.values())), *((e if isinstance(e, Column) else F.max(F.lit(e))).cast("bigint").alias(f"e{i}") for i, (_, e) in enumerate(predicates.values())))
    fixed = [None if isinstance(e, Column) else e for _, e in predicates.values()]
    rows = F.array(*(F.struct(F.lit(n).alias("name"), (F.col(f"e{i}") if fixed[i] is None else F.lit(fixed[i]).cast("bigint")).alias("expected"), F.col(f"c{i}").alias("got")) for i, n in enumerate(predicates)))
    return counts.select(F.inline(rows)).withColumn("status", F.when(F.col("got") == F.col("expected"), "OK").otherwise("FAIL"))


def composition(df: DataFrame, column: str, targets: DataFrame, tolerance: float = 0.003) -> DataFrame:
    """Share of every category against its target (category, target): count, share, within."""
    counts = df.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    joined = targets.join(counts, "category", "left").na.fill(0, ["n"]).crossJoin(F.broadcast(total))  # total is one row
    share = F.coalesce(F.try_divide("n", "total"), F.lit(0.0))
    return joined.select("category", "n", share.alias("share"), "target", (F.abs(share - F.col("target")) <= tolerance).alias("within"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def undefined(referenced: DataFrame, defined: DataFrame, key: str) -> DataFrame:
    """Referenced keys that are not defined, with their number of references."""
    return referenced.filter(F.col(key).isNotNull()).join(defined.select(key), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def resolve(references: DataFrame, known: DataFrame, target: str = "target") -> DataFrame:
    """references with resolved: their target is a known path, or a known path's last part. Two equi-joins instead of an OR."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    paths = known.select(F.col("path").alias("__path")).distinct().withColumn("__by_path", F.lit(True))
    names = known.select(last(F.col("path")).alias("__name")).distinct().withColumn("__by_name", F.lit(True))
    joined = references.join(paths, F.col(target) == F.col("__path"), "left").join(names, last(F.col(target)) == F.col("__name"), "left")
    return joined.withColumn("resolved", F.coalesce("__by_path", F.lit(False)) | F.coalesce("__by_name", F.lit(False))).drop("__path", "__by_path", "__name", "__by_name")


def status_of(checked: Column, failed: Column) -> Column:
    return F.when(checked == 0, "WARN").when(failed > 0, "FAIL").otherwise("OK")


def answerable(c: Column, patterns: list[str]) -> Column:
    """All patterns are found."""
    return reduce(lambda a, b: a & b, (c.rlike(p) for p in patterns), F.lit(True))


def compare(a: DataFrame, b: DataFrame, key: str, volatile: tuple[str, ...] = ()) -> DataFrame:
    """key, status (added, removed, changed, same) and the names of changed columns, nulls equal, volatile columns left out."""
    names = [c for c in a.columns if c != key and c in b.columns and c not in volatile]
    x = a.select(key, F.struct(*names).alias("__a"))
    y = b.select(key, F.struct(*names).alias("__b"))
    differ = F.array_compact(F.array(*(F.when(~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")), F.lit(c)) for c in names)))
    joined = x.join(y, key, "full_outer")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    changed = F.when(both, differ).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("same")
    return joined.select(key, status.alias("status"), changed.alias("columns"))


def ranked(checks: DataFrame) -> DataFrame:
    """Checks with the worst first, then by category."""
    return checks.orderBy(F.array_position(F.array(*map(F.lit, ORDER)), F.col("status")), "category")


def all_equal(df: DataFrame, text: Column, by: list[str] | None = None) -> DataFrame:
    """by, variants, n, equal: whether all texts are one after normalisation; nothing to compare is not equal."""
    return df.groupBy(*by or []).agg(F.count_distinct(F.md5(text)).alias("variants"), F.count("*").alias("n")).withColumn("equal", F.col("variants") == 1)


def tallies(checks: DataFrame) -> DataFrame:
    """One row: checks by status and the exit code, 1 if any fails. No check at all is a warning."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    got = checks.agg(*map(of, ORDER), F.count("*").alias("n"))
    return got.withColumns({"status": F.when(F.col("FAIL") > 0, "FAIL").when((F.col("WARN") > 0) | (F.col("n") == 0), "WARN").otherwise("OK"), "exit_code": F.when(F.col("FAIL") > 0, 1).otherwise(0)})


def header_differences(found: DataFrame, expected: DataFrame, column: str = "column") -> DataFrame:
    """column, side (missing or unexpected) of two tables of names."""
    a, b = found.select(column).distinct(), expected.select(column).distinct()
    return b.join(a, column, "left_anti").withColumn("side", F.lit("missing")).union(a.join(b, column, "left_anti").withColumn("side", F.lit("unexpected")))


def required(expected: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """expected with status: FAIL where no row of found has the same keys. Null keys are equal to each other."""
    there = found.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct().withColumn("__there", F.lit(True))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    status = F.when(F.col("__there"), "OK").otherwise("FAIL").alias("status")
    return expected.join(there, same, "left").select(*(expected[c] for c in expected.columns), status)


def milestones(plan: Column, state: Column) -> dict[str, Column]:
    """What a plan and a state document call the current milestone, whether they agree, and whether the plan contradicts itself.

    Only the text between the plan's heading of a milestone and the next heading counts as its section. Unknown on either side is a warning.
    """
    head = F.regexp_extract(plan, r"Current position:\s*\**([^*\n]+)", 1)
    current = F.nullif(F.regexp_extract(head, r"(?i)\b(M\d)\b[^·|]{0,60}?IN PROGRESS", 1), F.lit(""))
    stage = F.nullif(F.regexp_extract(F.regexp_extract(state, r"(?m)^- Stage:\s*(.+)$", 1), r"\b(M\d)\b", 1), F.lit(""))
    done = F.array_distinct(F.regexp_extract_all(head, F.lit(r"(?i)\b(M\d)\s*complete"), F.lit(1)))
    sections = F.regexp_extract_all(plan, F.lit(r"(?sm)^##\s*(M\d\b.*?)(?=^##\s|\z)"), F.lit(1))
    running = F.filter(sections, lambda x: F.upper(x).contains("IN PROGRESS"))
    against = F.exists(running, lambda x: F.array_contains(done, F.left(x, F.lit(2))))
    status = F.when(current.isNull() | stage.isNull(), "WARN").when((current != stage) | against, "FAIL").otherwise("OK")
    return {"plan_milestone": current, "state_milestone": stage, "contradiction": against, "status": status}


def gated(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """rows if every check (name, status) is OK; otherwise nothing is written and the failed names are raised."""
    bad = [r.name for r in checks.filter(F.col("status") != "OK").select("name").orderBy("name").collect()]  # a hand-written list of checks
    if bad:
        raise ValueError(f"not written: {', '.join(bad)}")
    return rows
