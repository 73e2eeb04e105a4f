"""Ad-hoc SQL within one tenant.

A query runs in a session of its own with views of the tenant's rows.  What may run is
decided on plans, not on text: Spark's own parser reads the query, and every node and every
expression of the tree must be of a class listed below, relations must be those views by
their bare names, and functions must be on a list.  Then the analysed plan is read: each of
its leaves must lie inside one of the views, and no expression may call user code or methods
by reflection.  Whatever these lists do not name is refused: set operations, common table
expressions, commands, table functions, samples, time travel, hints and the like.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS, DEFAULT_ROWS, SECONDS = 200, 50, 10
FUNCTIONS = frozenset(
    "count sum avg min max round bround floor ceil abs greatest least coalesce nullif ifnull nvl if upper lower length char_length octet_length trim ltrim rtrim "
    "substr substring left right replace concat concat_ws split instr locate position lpad rpad regexp_extract regexp_replace regexp_like rlike contains startswith endswith "
    "date to_date to_timestamp date_format date_add date_sub datediff date_trunc trunc year quarter month day dayofmonth hour minute second weekday months_between add_months "
    "last_day row_number rank dense_rank lag lead first_value last_value ntile percentile median stddev variance count_if max_by min_by mode collect_list collect_set "
    "extract between array array_contains size array_join explode get_json_object json_array_length sha2 md5 hex sign mod power sqrt ln log exp".split()
)
#: Nodes that a parsed query may hold.
NODES = frozenset(
    "Project Filter Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit Offset Join SubqueryAlias UnresolvedRelation Distinct UnresolvedSubqueryColumnAliases".split()
)
#: Expressions that a parsed query may hold besides functions of the list.
EXPRESSIONS = frozenset(
    "Literal UnresolvedAttribute UnresolvedAlias UnresolvedStar Alias MultiAlias UnresolvedFunction UnresolvedExtractValue UnresolvedOrdinal SortOrder "
    "EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual And Or Not In InSubquery ListQuery Exists ScalarSubquery IsNull IsNotNull IsTrue IsFalse IsUnknown IsNotUnknown "
    "Between UnresolvedBetween Like ILike LikeAll LikeAny NotLikeAll NotLikeAny RLike Cast CaseWhen If Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive "
    "Concat Extract Substring StringTrim StringTrimLeft StringTrimRight StringLocate Overlay CreateNamedStruct WindowExpression WindowSpecDefinition SpecifiedWindowFrame "
    "UnspecifiedFrame CurrentRow UnboundedPreceding UnboundedFollowing".split()
)
CATALYST = "org.apache.spark.sql.catalyst.expressions."
#: Expressions that an analysed query may not hold: code of users, reflection, and what tells of files or of the session.
REFUSED = frozenset(
    "ScalaUDF PythonUDF PythonUDAF PythonUDTF CallMethodViaReflection TryReflect StaticInvoke Invoke NewInstance InvokeLike ApplyFunctionExpression V2Aggregator "
    "InputFileName InputFileBlockStart InputFileBlockLength CurrentUser CurrentCatalog CurrentDatabase SparkVersion GetVariable VariableReference".split()
)


class Rejected(ValueError):
    """The query may not run; the message names no data."""


class TimedOut(TimeoutError):
    """The query took longer than it may."""


def _each(seq: JavaObject) -> list[JavaObject]:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _parsed_expression(e: JavaObject, names: frozenset[str]) -> int:
    kind = _kind(e)
    if kind not in EXPRESSIONS:
        raise Rejected(f"{kind} may not stand in a query")
    if kind == "UnresolvedFunction":
        parts = _each(e.nameParts())
        if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
            raise Rejected("a function may not be called")
    read = _parsed_plan(e.plan(), names) if kind in ("ListQuery", "Exists", "ScalarSubquery") else 0
    return read + sum(_parsed_expression(c, names) for c in _each(e.children()))


def _parsed_plan(plan: JavaObject, names: frozenset[str]) -> int:
    """Reads a parsed plan whole; gives the number of its relations."""
    kind = _kind(plan)
    if kind not in NODES:
        raise Rejected(f"{kind} may not stand in a query")
    read = 0
    if kind == "UnresolvedRelation":
        parts = _each(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in names:
            raise Rejected("only the tables given may be read")
        read = 1
    read += sum(_parsed_expression(e, names) for e in _each(plan.expressions()))
    return read + sum(_parsed_plan(c, names) for c in _each(plan.children()))


def _analysed_expression(e: JavaObject, names: frozenset[str]) -> None:
    name = e.getClass().getName()
    if not name.startswith(CATALYST) or _kind(e) in REFUSED:
        raise Rejected(f"{_kind(e)} may not stand in a query")
    if _kind(e) in ("ListQuery", "Exists", "ScalarSubquery"):
        _analysed_plan(e.plan(), names)
    for c in _each(e.children()):
        _analysed_expression(c, names)


def _analysed_plan(plan: JavaObject, names: frozenset[str]) -> None:
    """Each leaf lies inside a view of the tenant, which is not looked into."""
    if _kind(plan) == "View":
        table = plan.desc().identifier()
        if not plan.isTempView() or table.database().isDefined() or table.table().lower() not in names:
            raise Rejected("only the tables given may be read")
        return
    children = _each(plan.children())
    if not children:
        raise Rejected("only the tables given may be read")
    for e in _each(plan.expressions()):
        _analysed_expression(e, names)
    for c in children:
        _analysed_plan(c, names)


def query(
    spark: SparkSession, sql: str, load: Callable[[SparkSession, str], DataFrame], tables: Iterable[str], tenant: object,
    limit: int = DEFAULT_ROWS, column: str = "tenant", open_tables: Iterable[str] = (),
) -> DataFrame:
    """At most `limit` rows of a single SELECT over the tenant's tables; binary columns show their length.

    load reads a table in the session given; tables without the tenant column are not opened, those of
    `open_tables` alone are read whole.  Without a tenant (None or '') no table of tenants is opened.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.runSQLOnFiles", "false")  # a path is no table
    own.conf.set("spark.sql.variable.substitute", "false")  # ${env:...} is text
    names = set()
    for name in [*tables, *open_tables]:
        rows = load(own, name)
        if name in set(open_tables):
            shown = rows
        elif column in rows.columns and tenant not in (None, ""):
            shown = rows.where(F.col(column) == F.lit(tenant))
        else:
            continue
        shown.createOrReplaceTempView(name)
        names.add(name.lower())
    allowed = frozenset(names)
    text = sql.strip().rstrip(";").strip()
    try:
        parsed = own._jsparkSession.sessionState().sqlParser().parsePlan(text)
        if not _parsed_plan(parsed, allowed):
            raise Rejected("a query reads a table")
        out = own.sql(text)
        _analysed_plan(out._jdf.queryExecution().analyzed(), allowed)
    except (AnalysisException, ParseException) as e:
        raise Rejected(f"the query cannot run: {e.getCondition() or 'error'}") from e
    except Py4JJavaError as e:
        raise Rejected("the query cannot be read") from e
    most = max(1, min(limit, MOST_ROWS))
    return out.limit(most).select(*(_shown(c, t) for c, t in out.dtypes))


def _shown(c: str, kind: str):
    quoted = F.col("`" + c.replace("`", "``") + "`")
    return F.concat(F.lit("<bytes:"), F.octet_length(quoted).cast("string"), F.lit(">")).alias(c) if kind == "binary" else quoted


def answer(df: DataFrame, limit: int = DEFAULT_ROWS, seconds: float = SECONDS) -> dict:
    """What query() found, as columns, rows, row_count and truncated; all its jobs are stopped after so many seconds.

    df was asked for with one row more than `limit`, so that it tells whether more rows follow.
    """
    # a session's tags are known to their own thread alone; those of the context are found from any
    sc, tag = df.sparkSession.sparkContext, f"governed-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    sc.setInterruptOnCancel(True)  # else tasks that run go on
    timer.start()
    try:
        found = [list(r) for r in df.collect()]
    except Exception as e:
        if late.is_set():
            raise TimedOut(f"the query took longer than {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
        sc.setInterruptOnCancel(False)
    return {"columns": df.columns, "rows": found[:limit], "row_count": len(found[:limit]), "truncated": len(found) > limit}
