"""Secret scans with an incremental blob ledger.

Every version of a file is addressed by the digest of its content. The ledger, a table on shared files,
notes which blob was scanned under which rule and version, with the findings. A scan reads only blobs that
lack a current rule, runs just the missing rules on each, appends to the ledger, and joins the findings
back to every path that holds the blob. A text with many copies is scanned once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.words import text_or_empty
from stockloom.session import shared_folder, staged


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost non-overlapping matches are findings if ``group`` has ``least`` characters.

    ``hints``: a match needs one of these in the text (in lower case with ``any_case``), a cheap test first.
    """

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    hints: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def find(self, text: str, lower: str) -> list[tuple[int, int]]:
        if self.hints and not any(h in (lower if self.any_case else text) for h in self.hints):
            return []
        flags = re.ASCII | (re.IGNORECASE if self.any_case else 0)
        matches = re.compile(self.pattern, flags).finditer(text)
        return [m.span() for m in matches if len(m.group(self.group)) >= self.least]


# The base rules, then those added. A hex run below its least length never holds a longer one,
# so its length stands in the pattern.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 16, hints=("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?!-----)[\s\S])*-----END [A-Z ]*PRIVATE KEY-----", hints=("PRIVATE KEY",)),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("gh",)),
    Rule("jwt", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", hints=("eyJ",)),
)
BASE = ("assign", "access", "hex")

_SPANS = "array<struct<rule:string,start:int,end:int>>"


def _scanner(rules: tuple[Rule, ...]):
    by_name = {r.name: r for r in rules}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for blob, text, todo in zip(batch["blob"], batch["text"], batch["todo"]):
                lower = text.lower() if text.isascii() else text.translate(_ASCII_LOWER)
                spans = [{"rule": name, "start": a, "end": b} for name in todo for a, b in by_name[name].find(text, lower)]
                out.append((blob, list(todo), spans))
            yield pd.DataFrame(out, columns=["blob", "rules", "spans"])

    return scan


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def open_ledger(spark, folder: str) -> DataFrame:
    """The ledger's rows (blob, rules, spans) so far; none if nothing was written yet."""
    schema = f"blob string, rules array<string>, spans {_SPANS}"
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def unseen(paths: DataFrame, folder: str, *, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The blobs of ``paths`` (path, blob) that lack a rule in the ledger: blob, one path that holds it, and the rules ``todo``. Reads no text."""
    names = F.array(*[F.lit(r.name) for r in rules])
    seen = open_ledger(paths.sparkSession, folder).select("blob", F.explode("rules").alias("rule")).groupBy(F.col("blob").alias("_blob")).agg(F.collect_set("rule").alias("seen"))
    blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
    todo = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
    new = blobs.join(seen, F.col("blob") == F.col("_blob"), "left").select("blob", "path", todo.alias("todo"))
    return new.filter(F.size("todo") > 0)


def scan_new(contents: DataFrame, folder: str, *, paths: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, batch: str | None = None) -> int:
    """Scan ``contents`` (path, blob, text) for the pairs of blob and rule version that the ledger lacks, and note them.

    Digests (``paths``, if they are written already) are compared with the ledger first; then the text of one
    path for each unseen blob is scanned, and nothing else. Gives the number of unseen blobs. The findings of
    one call go to one part of the ledger named ``batch``; repeating a call that failed overwrites its own
    part, and one that was completed leaves nothing to scan.
    """
    known = contents.select("path", "blob") if paths is None else paths
    new = staged(unseen(known, folder, rules=rules), "unseen-blobs").withColumnsRenamed({"blob": "_blob", "path": "_path"})
    count = new.count()
    if count:
        held = contents.join(new, (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("_path")))
        found = held.select("blob", "text", "todo").mapInPandas(_scanner(rules), f"blob string, rules array<string>, spans {_SPANS}")
        # A path may be listed twice with one text; the ledger holds a blob once.
        found.dropDuplicates(["blob"]).write.mode("overwrite").parquet(f"{folder}/part={batch or uuid.uuid4().hex}")
    return count


def findings(paths: DataFrame, folder: str, *, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``paths`` (with blob) with the spans found in their blob under the current rules, in order."""
    current = F.array(*[F.lit(r.name) for r in rules])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    spans = open_ledger(paths.sparkSession, folder).select("blob", "spans").filter(F.size("spans") > 0)
    spans = spans.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    kept = F.filter("spans", lambda s: F.array_contains(current, s["rule"]))
    placed = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.array_position(current, s["rule"]).alias("at"), s["end"].alias("end")))
    spans = spans.select(F.col("blob").alias("_blob"), F.sort_array(F.array_distinct(placed)).alias("_placed"))
    joined = paths.join(spans, F.col("blob") == F.col("_blob"), "left").drop("_blob")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    named = F.transform("_placed", lambda s: F.struct(F.element_at(kinds, s["at"].cast("int")).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.withColumn("spans", F.coalesce(named, none)).drop("_placed")


def blob_of(text_col: str) -> Column:
    return F.sha2(text_or_empty(text_col), 256)


def scan_history(history: list[DataFrame], *, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per path of every version in ``history``: version, doc_id, blob and spans (kind, start, end; code points, end exclusive).

    Versions are scanned one after the other; a later one only adds what no earlier one held. Null text is
    the empty blob. Repeated rows get a row each (a path repeated with one text may be scanned as often). ``ledger``
    is the ledger's folder; without one, a new ledger is begun in the shared folder. Only the named columns are read.
    """
    folder = ledger or f"{shared_folder(history[0].sparkSession)}/stockloom/ledger-{uuid.uuid4().hex}"
    listed = []
    for number, docs in enumerate(history):
        digests = docs.select(F.lit(number).alias("version"), F.col(id_col).alias("doc_id"), blob_of(text_col).alias("blob"))
        paths = staged(digests, "paths")
        listed.append(paths)
        contents = docs.select(F.col(id_col).alias("path"), blob_of(text_col).alias("blob"), text_or_empty(text_col).alias("text"))
        scan_new(contents, folder, paths=paths.select(F.col("doc_id").alias("path"), "blob"), rules=rules)
    return findings(reduce(DataFrame.unionByName, listed), folder, rules=rules)


def scan_versions(docs: DataFrame, **options) -> DataFrame:
    """``scan_history`` of one version, without its number."""
    return scan_history([docs], **options).drop("version")
