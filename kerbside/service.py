"""Questions to rows: a read-only SQL service over the session's views.

A text generator, given by the caller, writes SQL for a question; the gate lets
queries through and nothing else; a second call may put the rows in words.
"""

from __future__ import annotations

import datetime
import decimal
import math
import re
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.sql import NAMES, register

# Rows for the summary, rows returned, rows shown.
SUMMARY_ROWS, RETURN_ROWS, SHOWN_ROWS = 20, 50, 10
#: Logical plans that only read, as the parser makes them.
_READS = frozenset("Project Filter Sort GlobalLimit LocalLimit Offset Aggregate Distinct Union Intersect Except UnresolvedWith Join SubqueryAlias UnresolvedRelation UnresolvedHaving LateralJoin Generate WithWindowDefinition UnresolvedInlineTable UnresolvedSubqueryColumnAliases Pivot Unpivot OneRowRelation UnresolvedHint Sample UnresolvedTableValuedFunction LocalRelation ResolvedInlineTable".split())
#: Groups of built-in functions, as the catalog names them, that compute from their arguments alone, and such functions of other groups.
_GROUPS = frozenset("agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs window_funcs".split())
_FUNCTIONS = frozenset(("typeof", "equal_null", *NAMES))
#: Functions whose value is as large as a number says, and the place of that number among their arguments.
_GROWING = {"repeat": 1, "space": 0, "lpad": 1, "rpad": 1, "array_repeat": 1}
#: How large such values, and `sequence`, may get: the product of all such numbers of a query.
GROWTH = 1_000_000
#: Table functions that make rows from their arguments alone.
_TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())


class Refused(ValueError):
    """The text is no query."""


def extract_sql(answer: str) -> str:
    """The SQL of a generator's answer.

    Read line by line: what stands between thought marks goes, the first fenced block is
    taken where there is one, and lines before the one on which the query begins go.
    """
    kept: list[str] = []
    fenced: list[str] | None = None
    thinking = False
    for line in answer.replace("<think>", "\n<think>\n").replace("</think>", "\n</think>\n").splitlines():
        bare = line.strip()
        if bare in ("<think>", "</think>"):
            thinking = bare == "<think>"
        elif thinking:
            continue
        elif bare.startswith("```"):
            if fenced is not None:
                break
            # a fence may hold the query on its own line
            inner = bare.strip("`").strip()
            fenced = [inner.removeprefix("sql").strip()]
            if bare.endswith("```") and len(bare) > 3:
                break
        else:
            (kept if fenced is None else fenced).append(line)
    text = "\n".join(fenced if fenced is not None else kept)
    begins = re.search(r"(?<![\w'])\(*\s*(?:with\s+(?:recursive\s+)?\w+\s*(?:\([^)]*\)\s*)?as\s*\(|select\b)", text, re.I)
    return text[begins.start() if begins else 0 :].strip().removesuffix(";").rstrip()


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


class _Gate:
    """Walks a parsed query, its expressions and the queries in them."""

    def __init__(self, spark: SparkSession) -> None:
        self.state = spark._jsparkSession.sessionState()
        self.gateway = spark.sparkContext._gateway
        self.growth = 1
        self.identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier

    def plan(self, node, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind not in _READS:
            raise Refused(f"plans {kind}")
        if kind == "UnresolvedRelation":
            self.relation(_items(node.multipartIdentifier()), scope)
        elif kind == "UnresolvedTableValuedFunction":
            self.known(_items(node.name()), _TABLE_FUNCTIONS)
        elif kind == "UnresolvedWith":
            for named in _items(node.cteRelations()):
                name = named._1().lower()
                self.plan(named._2(), scope | {name} if node.allowRecursion() else scope)
                scope |= {name}
        elif kind == "WithWindowDefinition":
            for definition in _items(node.windowDefinitions().values().toSeq()):
                self.expression(definition, scope)
        for x in _items(node.expressions()):
            self.expression(x, scope)
        for x in _items(node.children()):
            self.plan(x, scope)

    def expression(self, node, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            self.function(_items(node.nameParts()))
            self.size(_items(node.nameParts())[-1].lower(), _items(node.arguments()))
        elif kind == "UnresolvedGenerator":
            if node.name().database().isDefined():
                raise Refused(f"uses {node.name()}")
            self.known([node.name().funcName()], _TABLE_FUNCTIONS)
        elif kind == "ExpressionWithUnresolvedIdentifier":
            raise Refused(f"uses {kind}")
        if is_instance_of(self.gateway, node, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
            self.plan(node.plan(), scope)
        for x in _items(node.children()):
            self.expression(x, scope)

    def relation(self, parts: list[str], scope: frozenset[str]) -> None:
        if len(parts) != 1 or parts[0].lower() not in scope and not self.state.catalog().getTempView(parts[0]).isDefined():
            raise Refused(f"reads {'.'.join(parts)}, which is no view of this session")

    def known(self, parts: list[str], names: frozenset[str]) -> None:
        if len(parts) != 1 or parts[0].lower() not in names:
            raise Refused(f"uses {'.'.join(parts)}")

    def size(self, name: str, arguments: list) -> None:
        """Refuses values that a few characters of SQL make as large as the memory."""
        if name == "sequence":
            ends = [self.number(a) for a in arguments[:2]]
            size = None if None in ends or len(ends) < 2 else abs(ends[1] - ends[0]) + 1
        elif name in _GROWING:
            size = self.number(arguments[_GROWING[name]]) if len(arguments) > _GROWING[name] else None
        else:
            return
        if size is None:
            raise Refused(f"uses {name} with a size that is no plain number")
        self.growth *= max(1, size)
        if self.growth > GROWTH:
            raise Refused(f"makes values of {self.growth} parts with {name}")

    @staticmethod
    def number(node) -> int | None:
        text = node.toString() if node.getClass().getSimpleName() == "Literal" else ""
        return int(text) if re.fullmatch(r"-?\d{1,18}", text) else None

    def function(self, parts: list[str]) -> None:
        name = parts[0].lower()
        if len(parts) == 1 and name in _FUNCTIONS:
            return
        try:
            info = self.state.catalog().lookupFunctionInfo(self.identifier(name)) if len(parts) == 1 else None
        except Exception:  # noqa: BLE001  the catalog throws for names it doesn't know
            info = None
        if info is None or info.getGroup() not in _GROUPS or info.getSource() != "built-in":
            raise Refused(f"uses {'.'.join(parts)}")


def check(spark: SparkSession, sql: str) -> None:
    """Raises Refused unless the text is one query over the session's temporary views.

    The parsed plan decides, with its expressions, subqueries, common tables
    and named windows: only nodes that read, only temporary views and common
    tables in scope, only built-in functions that compute from their arguments
    and this engine's own.  Reflection, files, catalogs and what tells of the
    system are out.  Values that a number of the query makes large are bounded
    by GROWTH, all together.  Nothing is analysed or run before.
    """
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    if not re.match(r"[\s(]*(select|with)\b", bare, re.I):
        raise Refused("not a SELECT")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused(f"does not parse: {str(e).splitlines()[0][:200]}") from None
    _Gate(spark).plan(plan, frozenset())


def run(spark: SparkSession, sql: str) -> DataFrame:
    """The rows of a checked query."""
    check(spark, sql)
    return spark.sql(sql)


def plain(value):
    """A value for JSON: dates as text, decimals as numbers, no NaN."""
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (bytes, bytearray)):
        return value.hex()
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


#: Questions with queries that show joins, windows and this engine's functions.
EXAMPLES = {
    "Rank the cameras within each class by the number of tracks that they see.": "SELECT class, cctv_id, n, rank() OVER (PARTITION BY class ORDER BY n DESC) AS place FROM (SELECT class, cctv_id, count(DISTINCT track_id) AS n FROM detection GROUP BY class, cctv_id)",
    "What is the 90th percentile of speed where a camera has a name?": "SELECT c.name, percentile(d.speed_kmh, 0.9) AS p90 FROM detection d JOIN cctv c USING (cctv_id) WHERE c.name IS NOT NULL GROUP BY c.name",
    "How many detections lie within 30 m of the point 100, 200?": "SELECT count(*) AS n FROM detection WHERE st_dwithin(st_makepoint(easting, northing), st_makepoint(100D, 200D), 30D)",
}


@dataclass
class QueryService:
    """Answers questions over the session's temporary views.

    `generate` maps a prompt to text; without it only SQL is answered.  Jobs of
    an answer that takes longer than `seconds` are cancelled, by a tag of their
    own, so that others of the session go on.
    """

    spark: SparkSession
    generate: Callable[[str], str] | None = None
    seconds: float = 120.0

    def __post_init__(self) -> None:
        register(self.spark)

    def schema_text(self) -> str:
        """Views, their columns, and the functions beyond Spark's own."""
        views = sorted(t.name for t in self.spark.catalog.listTables() if t.isTemporary)
        lines = [f"{v}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in self.spark.table(v).schema.fields)})" for v in views]
        return "\n".join([*lines, "functions: " + ", ".join(NAMES)])

    def prompt(self, question: str) -> str:
        parts = ["Write one Spark SQL query, and no more than that, for the last question.", "-- views", self.schema_text(), "-- examples"]
        parts += [f"/* {asked} */\n{sql};" for asked, sql in EXAMPLES.items()]
        return "\n".join([*parts, "-- question", f"/* {question.replace('*/', '* /')} */"])

    def sql(self, text: str) -> dict:
        """{backend, sql, columns, rows, truncated}, or {backend, sql, error}."""
        tag, late = f"answer-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            self.spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(self.seconds, stop)
        self.spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            df = run(self.spark, text)
            rows = df.limit(RETURN_ROWS + 1).collect()
        except Exception as e:  # noqa: BLE001  the caller gets the reason
            return {"backend": "spark", "sql": text, "error": f"took more than {self.seconds:g} seconds" if late.is_set() else str(e).splitlines()[0]}
        finally:
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)
        return {"backend": "spark", "sql": text, "columns": df.columns, "rows": [[plain(v) for v in r] for r in rows[:RETURN_ROWS]], "truncated": len(rows) > RETURN_ROWS}

    def ask(self, question: str, llm: Callable[[str], str] | None = None, summarise: bool = True) -> dict:
        """As `sql`, for a question in words, with an `answer` in words if asked for."""
        generate = llm or self.generate
        if generate is None:
            raise ValueError("a text generator is needed for questions in words")
        out = self.sql(extract_sql(generate(self.prompt(question))))
        if summarise and "rows" in out:
            out["answer"] = generate(f"Question: {question}\nColumns: {out['columns']}\nRows: {out['rows'][:SUMMARY_ROWS]}\nAnswer in one sentence.").strip()
        return out


# Words by which a question asks for a place on the map.
_MAP_WORDS = "show|find|where|go to|zoom|fly|move"


def map_command(questions: DataFrame, cameras: DataFrame) -> DataFrame:
    """Rows (question_id, cctv_id): questions (question_id, text) that ask for a place and name a camera, white space and case aside; the first name in order on several.

    Pieces of a question as long as some name meet the names by an equi-join.
    """
    c = cameras.where("name is not null and trim(name) <> ''").select("cctv_id", "name", F.lower(F.regexp_replace("name", r"\s+", "")).alias("_n")).where("_n <> ''")
    sizes = sorted(r[0] for r in c.select(F.length("_n")).distinct().collect())  # as many as the longest name has characters, at most
    q = questions.where(F.lower("text").rlike(rf"\b({_MAP_WORDS})\b")).select("question_id", F.lower(F.regexp_replace("text", r"\s+", "")).alias("_t"))
    places = q.withColumn("_size", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))).where(F.col("_size") <= F.length("_t"))
    places = places.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("_t") - F.col("_size") + 1))).select("question_id", F.col("_t").substr(F.col("_at"), F.col("_size")).alias("_n"))
    return places.distinct().join(c, "_n").groupBy("question_id").agg(F.min_by("cctv_id", F.struct("name", "cctv_id")).alias("cctv_id"))


def views(detections: DataFrame, cameras: DataFrame, links: DataFrame | None = None) -> list[str]:
    """Makes `detection`, `cctv`, `cctv_summary` (and `detection_on_link` where there are links) known to the session's SQL."""
    from .operators.spatial_join import project_onto
    from .operators.summaries import camera_summary

    made = {"detection": detections, "cctv": cameras, "cctv_summary": camera_summary(detections, cameras)}
    if links is not None:
        placed = detections.withColumn("row_id", F.monotonically_increasing_id()).withColumn("x", F.col("easting")).withColumn("y", F.col("northing"))
        near = project_onto(placed.select("row_id", "x", "y"), links, "row_id", 50.0).groupBy("row_id").agg(F.min(F.struct("distance", "link_id")).alias("b")).select("row_id", "b.link_id", F.col("b.distance").alias("link_distance"))
        made["detection_on_link"] = placed.join(near, "row_id", "left").drop("row_id", "x", "y")
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return list(made)
