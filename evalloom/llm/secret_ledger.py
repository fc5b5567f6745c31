"""Secret scans over an incremental ledger of blobs, in Spark expressions only.

Every historical version of a text is addressed by the SHA-256 of its content. The ledger holds what
each (blob, rule, rule version) scan found; a run scans only pairs that the ledger lacks, each blob
once however many paths share it, and joins findings back to every path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.store import free_name, written

LEDGER = "blob string, rule string, version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a Java regular expression; matches whose ``group`` has under ``least`` characters are dropped."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


#: The base rules in their order, then the added ones.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


def spans(text: Column, rule: Rule) -> Column:
    """[start, end) in code points of the leftmost non-overlapping matches, short ones dropped.

    Splitting at the matches gives the lengths between them, so places are running sums. Runs of one
    class of characters that can't be long enough are left out of the pattern beforehand.
    """
    pattern = rule.pattern.removesuffix("+") + "{%d,}" % rule.least if rule.name == "hex" else rule.pattern
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    judged = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(rule.group + 1))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(F.zip_with(found, judged, lambda m, g: F.struct(F.length(m).alias("n"), F.length(g).alias("judged"))), F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))), lambda m, b: F.struct(m.n.alias("n"), m.judged.alias("judged"), F.length(b).alias("gap")))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, m: Column) -> Column:
        span = F.struct((acc.at + m.gap).alias("start"), (acc.at + m.gap + m.n).alias("end"))
        return F.struct((acc.at + m.gap + m.n).alias("at"), F.when(m.judged >= rule.least, F.concat(acc.out, F.array(span))).otherwise(acc.out).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc.out)).otherwise(empty)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text", into: str = "secrets") -> tuple[DataFrame, DataFrame]:
    """(``versions`` with an array ``into`` of (start, kind, end), the ledger after this run).

    Spans come by start, then by the order of ``rules``. ``ledger`` is what an earlier call returned.

    Defined results: a null text is the empty text and has no spans; repeated rows are each given the
    findings of their blob; findings of other rule versions stay in the ledger and are not reported;
    an empty table gives no rows and leaves the ledger; an existing column ``into`` is an error.
    """
    if into in versions.columns:
        raise ValueError(f"column {into!r} exists; name another")
    spark, blob = versions.sparkSession, free_name(versions, "blob")
    current = {(r.name, r.version): r for r in rules}
    content = F.coalesce(F.col(text), F.lit(""))
    blobs = versions.select(content.alias("content")).select(F.sha2("content", 256).alias("blob"), "content").groupBy("blob").agg(F.any_value("content").alias("content"))
    if ledger is None:
        ledger = spark.createDataFrame([], LEDGER)
        due = {k: F.lit(True) for k in current}
    else:
        known = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(v).alias("version")) for n, v in current))
        ours = ledger.where(F.array_contains(known, F.struct("rule", "version")))
        # one flag per current rule, so what meets in a row is bounded by the rules
        seen = ours.groupBy("blob").agg(*(F.max((F.col("rule") == n) & (F.col("version") == v)).alias(f"seen_{i}") for i, (n, v) in enumerate(current)))
        blobs = blobs.join(seen, "blob", "left")
        due = {k: ~F.coalesce(F.col(f"seen_{i}"), F.lit(False)) for i, k in enumerate(current)}
    results = F.array(*(F.when(due[k], F.struct(F.lit(k[0]).alias("rule"), F.lit(k[1]).alias("version"), spans(F.col("content"), r).alias("spans"))) for k, r in current.items()))
    new = blobs.select("blob", F.explode(F.filter(results, lambda x: x.isNotNull())).alias("r")).select("blob", "r.rule", "r.version", "r.spans")
    ledger = ledger.unionByName(written(new))

    order = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)))
    wanted = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(v).alias("version")) for n, v in current))
    found = ledger.where((F.size("spans") > 0) & F.array_contains(wanted, F.struct("rule", "version")))
    each = F.transform("spans", lambda s: F.struct(s.start.alias("start"), order[F.col("rule")].alias("order"), F.col("rule").alias("kind"), s.end.alias("end")))
    name, kind = free_name(versions, "found"), "array<struct<start:int,order:int,kind:string,end:int>>"
    per_blob = found.groupBy(F.col("blob").alias(blob)).agg(F.sort_array(F.flatten(F.collect_list(each))).alias(name))
    ordered = F.transform(F.coalesce(name, F.array().cast(kind)), lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    joined = versions.withColumn(blob, F.sha2(content, 256)).join(per_blob, blob, "left").withColumn(into, ordered)
    return joined.select(*versions.columns, into), ledger


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def masked(text: Column, found: Column) -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by ``[kind]`` of its first span."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s.start < acc.at
        more = F.when(inside, acc.out).otherwise(F.concat(acc.out, F.substring(text, acc.at + 1, s.start - acc.at), F.lit("["), s.kind, F.lit("]")))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), more.alias("out"))

    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, start, step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text)))))


def mask_secrets(docs: DataFrame, text: str = "text", chars: str = "n_chars", **options) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``chars``, where there is one, counted anew for masked rows; columns as they were."""
    into = free_name(docs, "_secrets")
    found, _ = scan(docs, text=text, into=into, **options)
    hit = F.size(into) > 0
    found = found.withColumn(text, masked(F.col(text), F.col(into)))
    if chars in docs.columns:
        found = found.withColumn(chars, F.when(hit, F.length(text)).otherwise(F.col(chars)).cast(docs.schema[chars].dataType))
    return found.select(*docs.columns)
