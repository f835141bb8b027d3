"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its text. The ledger
has a row per blob and scan: the rule versions applied and what each found. A run
first compares addresses alone with the ledger, then moves and scans only texts
with (blob, rule version) pairs that the ledger lacks, once per blob however many
paths share it, appends to the ledger, and joins the findings of the run's rule
versions back to all paths. Findings of other versions stay in the ledger and are
not returned.

Null texts count as empty. Repeated rows and equal texts share one blob and each
row gets its findings. Empty tables give empty results. Matches are leftmost and
non-overlapping per rule; a match that fails its rule's length test is dropped
but still uses up its text. Spans that start at one place are in the order of the
rules. Other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    #: Least length in characters of the group below.
    least: int = 0
    group: int = 0
    #: A text without any of these has no match; saves the regular expression.
    hints: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), _either("api") + "_?" + _either("key")])
ASSIGN = rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: In the order in which spans with equal starts are listed.
RULES = (
    Rule("assign", 1, ASSIGN, 6, 2),
    Rule("access", 1, "AKIA[A-Z0-9]+", 20, 0, ("AKIA",)),
    Rule("hex", 1, "[0-9a-f]+", 24),
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0, ("-----BEGIN ",)),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,255}", 0, 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0, ("eyJ",)),
)
BASE_KINDS = ("assign", "access", "hex")

#: Unseen blobs up to which their addresses are broadcast, so that texts of seen ones do not move; about 100 bytes each.
BROADCAST_BLOBS = 100_000

_SPAN = "struct<start:int,rank:int,kind:string,version:int,end:int>"
LEDGER = f"blob string, rules array<string>, spans array<{_SPAN}>"


def _find_pattern(rule: Rule) -> str:
    # A maximal run shorter than asked for can't become long enough further on, so the engine may skip it.
    return f"{rule.pattern[:-1]}{{{rule.least},}}" if rule.kind == "hex" and rule.pattern == "[0-9a-f]+" else rule.pattern


def _matches(text: Column, rule: Rule) -> Column:
    found = F.regexp_extract_all(text, F.lit(_find_pattern(rule)), F.lit(0))
    none = F.array().cast("array<string>")
    if rule.hints:
        hint = F.contains(text, F.lit(rule.hints[0]))
        for h in rule.hints[1:]:
            hint = hint | F.contains(text, F.lit(h))
        return F.when(hint, found).otherwise(none)
    return found


def _spans(text: Column, matches: Column, rule: Rule, rank: int) -> Column:
    """Places of the matches: what lies between them comes from splitting at the same pattern."""
    gaps = F.slice(F.split(text, _find_pattern(rule), -1), F.lit(1), F.size(matches))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + F.length(x["gap"])
        end = at + F.length(x["hit"])
        own = F.array(F.struct(at.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), end.alias("end")))
        value = F.regexp_extract(x["hit"], rule.pattern, rule.group) if rule.group else x["hit"]
        return F.struct(end.alias("pos"), F.when(F.length(value) >= rule.least, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate(F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("hit"))), start, step, lambda acc: acc["out"])
    return F.when(F.size(matches) > 0, walked).otherwise(F.array().cast(f"array<{_SPAN}>"))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows for blobs (blob, text, todo): each rule runs where ``todo`` names it."""
    none = F.array().cast("array<string>")
    found = blobs.select("blob", "todo", "text", *[F.when(F.array_contains("todo", r.name), _matches(F.col("text"), r)).otherwise(none).alias(f"m{i}") for i, r in enumerate(rules)])
    spans = [_spans(F.col("text"), F.col(f"m{i}"), r, i) for i, r in enumerate(rules)]
    return found.select("blob", F.col("todo").alias("rules"), F.array_sort(F.concat(*spans)).alias("spans"))


def ledger_at(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, todo): rule versions that the ledger lacks, for the addresses among ``versions`` (blob, ...); no text is read or moved."""
    names = F.array(*[F.lit(r.name) for r in rules])
    none = F.array().cast("array<string>")
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
    blobs = versions.select("blob").distinct().join(seen, "blob", "left")
    return blobs.select("blob", F.array_except(names, F.coalesce("seen", none)).alias("todo")).filter(F.size("todo") > 0)


def update_ledger(versions: DataFrame, ledger: DataFrame | None, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what is unseen among ``versions`` (blob, text), append it at ``path``, and return the whole ledger."""
    spark = versions.sparkSession
    if ledger is None:
        names = F.array(*[F.lit(r.name) for r in rules])
        # equal texts meet by their address; each task hands on one copy of each
        todo = versions.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", names)
    else:
        lacking = common.table(unseen(versions, ledger, rules))
        if lacking.count() <= BROADCAST_BLOBS:
            lacking = F.broadcast(lacking)
        todo = versions.join(lacking, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    common.write(scan_blobs(todo, rules), path, "append")
    return ledger_at(spark, path) if ledger is None else ledger.unionByName(ledger_at(spark, path))


def findings(book: DataFrame, rules: tuple[Rule, ...], several: bool) -> DataFrame:
    """(hit: blob, found) for blobs with spans by these rule versions, spans in order of start, then rule. ``several``: a blob may
    have a row for each run that scanned it."""
    hits = book.filter(F.size("spans") > 0)
    if several:
        hits = hits.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    names = F.array(*[F.lit(r.name) for r in rules])
    rank = lambda s: F.array_position(names, F.concat_ws("@", s["kind"], s["version"].cast("string"))).cast("int")
    found = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (rank(s) - 1).alias("rank"), s["kind"].alias("kind"), s["version"].alias("version"), s["end"].alias("end")))
    found = F.array_sort(F.array_distinct(F.filter(found, lambda s: s["rank"] >= 0)))
    return hits.select(F.col("blob").alias("hit"), found.alias("found")).filter(F.size("found") > 0)


def scan_rows(docs: DataFrame, ledger: DataFrame | None = None, path: str | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc, blob, spans) of every row; ``doc`` holds the columns in ``keep`` (all, if None), so that their names cannot clash.
    ``path`` is where new ledger rows go."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    doc = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    book = update_ledger(docs.select(F.sha2(text, 256).alias("blob"), text.alias("text")), ledger, path or common.shared_dir(spark), rules)
    rows = docs.select(doc.alias("doc"), F.sha2(text, 256).alias("blob"))
    hits = findings(book, rules, ledger is not None)
    out = rows.join(hits, F.col("blob") == F.col("hit"), "left")
    return out.select("doc", "blob", F.coalesce("found", F.array().cast(f"array<{_SPAN}>")).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, path: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every row: (id, blob, spans)."""
    found = scan_rows(docs, ledger, path, rules, text_col, [id_col])
    return found.select(F.col("doc").getField(id_col).alias(id_col), "blob", "spans")


def scan_in_runs(docs: DataFrame, runs: list[tuple[Rule, ...]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``scan`` by a ledger that grows over several runs, each with its rule versions; the last run's findings."""
    spark, book = docs.sparkSession, None
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    for rules in runs[:-1]:
        book = update_ledger(docs.select(F.sha2(text, 256).alias("blob"), text.alias("text")), book, common.shared_dir(spark), rules)
    return scan(docs, book, common.shared_dir(spark), runs[-1], id_col, text_col)


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *[count(k) for k in BASE_KINDS], F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mark``; overlapping spans count as one. All rows and columns stay."""
    found = scan_rows(common.fold(docs, text_col), None, None, rules).select("doc.doc", "doc.text", "spans")
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        between = text.substr(acc["pos"] + 1, s["start"] - acc["pos"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(s["start"] >= acc["pos"], F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], text.substr(acc["pos"] + 1, F.length(text))))
    return common.unfold(found.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(text)), docs, text_col)
