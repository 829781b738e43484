"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content.  The ledger is a written table with one row per scan
of a blob: ``blob, rules, findings``, where ``rules`` names each rule with its version.  A run scans only the pairs of blob
and rule version that no ledger row covers: new content under all rules, known content under new or changed rules.  Findings
are then joined back to all paths that hold the blob.

Defined results: null content is the empty text; null paths and versions are ordinary values; repeated rows each get their
findings; an empty table gives an empty result; extra columns are ignored.  Positions are code points, ends exclusive.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.lineage import by_sort, shared_folder
from skysift.llm.common import materialize

#: In the ledger a finding names the rule and its version, so findings of a rule that was changed or dropped are told apart.
FINDINGS = "array<struct<rule:string,start:long,end:long>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost without overlaps; a match shorter than ``least`` (in ``group``) is dropped.

    ``needs`` are lower-case strings; a text whose lower-case form holds none of them cannot match.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()
    any_case: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds, in the order in which equal starts are listed.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key"), True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24),
)
#: Public token formats.
MORE = (
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", needs=("private key",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=("eyj",)),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", needs=("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
)
RULES = BASE + MORE
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")


def find(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """All findings of ``rules`` (key, start, end), by start, then in the order of the rules."""
    low = text.lower()
    out = []
    for place, rule in enumerate(rules):
        if rule.needs and not any(x in low for x in rule.needs):
            continue
        if rule.kind == "hex" and not _LONG_HEX.search(text):
            continue
        # ASCII only: no letter outside ASCII may fold into a keyword
        for m in re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0)).finditer(text):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), place, rule.key, m.end()))
    return [(key, start, end) for start, _, key, end in sorted(out)]


def _scanner(rules: tuple[Rule, ...]):
    by_key = {r.key: r for r in rules}

    @F.pandas_udf(FINDINGS)
    def scan(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for content, keys in batches:
            yield pd.Series([
                [{"rule": k, "start": s, "end": e} for k, s, e in find(t, tuple(r for key, r in by_key.items() if key in set(wanted)))]
                for t, wanted in zip(content, keys, strict=True)
            ])

    return scan


def _addressed(versions: DataFrame) -> DataFrame:
    content = F.coalesce(F.col("content"), F.lit(""))
    return versions.select("path", "version", F.sha2(content, 256).alias("blob"), content.alias("content"))


def scan_unseen(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> int:
    """Scan the pairs of blob and rule version that the ledger lacks and append them to it.

    ``versions`` has ``path, version, content``; ``ledger`` is a folder of a written table, created at the first run.
    Texts move once, to the one row that stands for each blob; addresses and ids alone decide what is moved.  Returns the
    number of blobs scanned.
    """
    spark = versions.sparkSession
    rows = _addressed(versions)
    blobs = rows.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
    now = F.array(*(F.lit(r.key) for r in rules))
    if exists(spark, ledger):
        seen = read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        missing = F.when(F.col("seen").isNull(), now).otherwise(F.array_except(now, F.col("seen")))
        blobs = blobs.join(by_sort(seen), "blob", "left").withColumn("missing", missing).where(F.size("missing") > 0)
    else:
        blobs = blobs.withColumn("missing", now)
    todo = blobs.select(F.col("blob").alias("address"), F.col("at.path").alias("at_path"), F.col("at.version").alias("at_version"), "missing")
    scan = _scanner(rules)
    fresh = rows.join(
        by_sort(todo), F.col("path").eqNullSafe(F.col("at_path")) & F.col("version").eqNullSafe(F.col("at_version")) & (F.col("blob") == F.col("address"))
    ).select("blob", F.col("missing").alias("rules"), scan("content", "missing").alias("findings"))
    before = read_ledger(spark, ledger).count() if exists(spark, ledger) else 0
    fresh.write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger).count() - before


def exists(spark, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_ledger(spark, ledger: str) -> DataFrame:
    return spark.read.schema(f"blob string, rules array<string>, findings {FINDINGS}").parquet(ledger)


def findings_by_path(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``path, version, blob, findings`` for every row of ``versions``, from the ledger.

    Only findings of the wanted rules in their wanted versions are listed, by start, then in the order of the rules.
    """
    order = F.array(*(F.lit(r.key) for r in rules))
    kind_of = lambda key: F.regexp_replace(key, "@[0-9]+$", "")
    found = (
        read_ledger(versions.sparkSession, ledger)
        .groupBy("blob")
        .agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("all"))
        .select(
            F.col("blob").alias("address"),
            F.array_sort(
                F.transform(
                    F.filter("all", lambda x: F.array_contains(order, x["rule"])),
                    lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["rule"]).alias("place"), x["end"].alias("end"), kind_of(x["rule"]).alias("kind")),
                )
            ).alias("found"),
        )
    )
    found = materialize(found, "ledger-findings")  # on its own, the join can split a blob that very many paths hold
    findings = F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    paths = _addressed(versions).select("path", "version", "blob")
    return paths.join(by_sort(found), F.col("blob") == F.col("address"), "left").select("path", "version", "blob", findings.alias("findings"))


def new_ledger(spark) -> str:
    return shared_folder(spark, "secret-ledger")


def as_versions(docs: DataFrame) -> DataFrame:
    """Documents as paths with one version each."""
    return docs.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), F.col("text").alias("content"))


def redact(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """Documents with every finding in ``text`` replaced by ``mark`` and, where there is one, ``n_chars`` renewed.

    The findings come from the ledger, by the address of the text; all rows and columns stay, null texts stay null.
    """
    names = docs.columns
    own = [f"{name}_{len(names)}_{i}" for i, name in enumerate(("address", "found"))]  # no column of docs has such a name
    while set(own) & set(names):
        own = [f"_{x}" for x in own]
    address, found = own
    wanted = F.array(*(F.lit(r.key) for r in rules))
    marked = (
        read_ledger(docs.sparkSession, ledger)
        .groupBy("blob")
        .agg(F.filter(F.array_distinct(F.flatten(F.collect_list("findings"))), lambda x: F.array_contains(wanted, x["rule"])).alias(found))
        .where(F.size(found) > 0)
        .select(F.col("blob").alias(address), found)
    )

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else blank_out(t, s, mark) for t, s in zip(text, spans, strict=True)])

    joined = docs.withColumn(address, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).join(by_sort(marked), address, "left")
    text = F.when(F.col(found).isNull(), F.col("text")).otherwise(cut("text", found))
    joined = joined.withColumn("text", text)
    if "n_chars" in names:
        joined = joined.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return joined.select(*names)


def blank_out(text: str, spans, mark: str) -> str:
    out, at = [], 0
    for start, end in sorted((int(s["start"]), int(s["end"])) for s in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]
