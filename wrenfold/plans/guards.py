"""Guards (G): a proof, on Catalyst's parse tree, that a query pins every table to one tenant; a catalogue of questions; public projections."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfold.functions import sql as F_SQL
from wrenfold.functions.rows import count_if, table
from wrenfold.registry import query


class Unscoped(ValueError):
    """A query that could read another tenant's rows."""


def _seq(x) -> Iterator:  # noqa: ANN001
    return (x.apply(i) for i in range(x.size()))


def _kind(node) -> str:  # noqa: ANN001
    return node.getClass().getSimpleName()


def _conjuncts(e) -> Iterator:  # noqa: ANN001
    if _kind(e) == "And":
        for c in _seq(e.children()):
            yield from _conjuncts(c)
    else:
        yield e


_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def prove_scoped(spark: SparkSession, sql: str, column: str = "tenant_id", tenant: object = None) -> list[str]:
    """The tables of a single SELECT, each pinned to the one tenant in its own clause; else raises.

    A table is pinned by an equality of its own ``column`` with the tenant: the literal ``tenant``, or a parameter of
    that name where ``tenant`` is None.  The equality must hold for every row of the table: it stands in the WHERE,
    in the ON of an inner join, or, for the inner side of an outer join alone, in its ON.  It carries over to
    another table by an equality of both their columns, under the same rule.  No other tenant may be named.
    """
    if "--" in sql or "/*" in sql or ";" in sql:
        raise Unscoped("comments and several statements aren't allowed")
    if not re.match(r"\s*SELECT\b", sql, re.IGNORECASE):
        raise Unscoped("not a bare SELECT")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    found: list[str] = []
    _block(plan, column.lower(), tenant, found)
    if not found:
        raise Unscoped("no table")
    return found


def _block(plan, column: str, tenant: object, found: list[str]) -> None:  # noqa: ANN001
    """One query block: relations down to the next block, and the conditions with the relations that each binds."""
    bound: list[tuple] = []  # (condition, relations that have only rows which meet it)
    names: list[str] = []

    def down(node, alias: str | None) -> set[str]:  # noqa: ANN001
        """The relations below a node that give rows to it."""
        kind = _kind(node)
        if kind in ("Union", "Intersect", "Except", "UnresolvedWith", "InsertIntoStatement", "SetOperation", "LateralJoin", "UnresolvedTableValuedFunction"):
            raise Unscoped(f"{kind} isn't allowed")
        if kind == "UnresolvedRelation":
            name = ".".join(_seq(node.multipartIdentifier()))
            own = (alias or name.rpartition(".")[2]).lower()
            if own in names:
                raise Unscoped(f"{own} is named twice")
            names.append(own)
            found.append(name)
            return {own}
        for e in _seq(node.expressions()):
            inside(e)
        inner = node.alias() if kind == "SubqueryAlias" else None
        below = []
        for child in _seq(node.children()):
            if inner and _kind(child) != "UnresolvedRelation":
                _block(child, column, tenant, found)  # a derived table proves itself
                below.append(set())
            else:
                below.append(down(child, inner))
        if kind == "Filter":
            bound.extend((c, below[0]) for c in _conjuncts(node.condition()))
        elif kind == "Join" and node.condition().isDefined():
            left, right = below
            sides = {"Inner": left | right, "Cross": left | right, "LeftSemi": left | right, "LeftOuter": right, "RightOuter": left, "LeftAnti": right}.get(node.joinType().toString(), set())
            bound.extend((c, sides) for c in _conjuncts(node.condition().get()))
        return set().union(*below)

    def inside(e) -> None:  # noqa: ANN001
        """Subqueries prove themselves; a text shaped like another tenant's id is refused."""
        if _kind(e) in ("Exists", "ScalarSubquery", "ListQuery"):
            _block(e.plan(), column, tenant, found)
        if _kind(e) == "Literal" and _UUID.fullmatch(e.toString()) and e.toString().lower() != str(tenant).lower():
            raise Unscoped("another id is named")
        for c in _seq(e.children()):
            inside(c)

    down(plan, None)
    pinned: set[str] = set()
    links: list[tuple[str, str]] = []  # the first pins the second
    for e, sides in bound:
        if _kind(e) != "EqualTo":
            continue
        both = list(_seq(e.children()))
        owners = [_owner(c, column, names) for c in both]
        if all(owners):
            links += [(x, y) for x, y in (owners, owners[::-1]) if y in sides]
        elif any(owners):
            own, other = (owners[0], both[1]) if owners[0] else (owners[1], both[0])
            if not _is_tenant(other, tenant):
                if _kind(other) in ("Literal", "NamedParameter"):
                    raise Unscoped(f"{own} is pinned to another tenant")
            elif own in sides:
                pinned.add(own)
    for _ in links:
        pinned |= {y for x, y in links if x in pinned}
    open_ = [r for r in names if r not in pinned]
    if open_:
        raise Unscoped(f"not pinned: {', '.join(open_)}")


def _owner(e, column: str, names: list[str]) -> str | None:  # noqa: ANN001
    """The relation whose tenant column this is; a bare column has one only if there is no other relation."""
    name = _column(e)
    if name == column:
        return names[0] if len(names) == 1 else None
    owner, _, last = (name or "").rpartition(".")
    return owner if last == column and owner in names else None


def _is_tenant(e, tenant: object) -> bool:  # noqa: ANN001
    if _kind(e) == "Literal":
        return tenant is not None and e.toString() == str(tenant)
    return tenant is None and _kind(e) == "NamedParameter" and e.name() == "tenant"


def _column(e) -> str | None:  # noqa: ANN001
    return ".".join(_seq(e.nameParts())).lower() if _kind(e) == "UnresolvedAttribute" else None


@dataclass(frozen=True)
class Question:
    """One thing that can be asked: how a person would say it, the statement that answers it, and its typed slots."""

    asks: str
    sql: str
    slots: dict[str, type]


_LIMIT = {"limit": int}
QUESTIONS = {
    "parties_by_segment": Question("How many customers do we know, and of what kind are they?", "SELECT p.segment, count(*) AS how_many FROM party p WHERE p.tenant_id = :tenant GROUP BY p.segment ORDER BY how_many DESC, p.segment LIMIT 25", {}),
    "status_spread": Question("Which states are our orders in?", "SELECT f.status, count(*) AS orders, max(f.price) AS largest FROM fact f WHERE f.tenant_id = :tenant GROUP BY f.status ORDER BY orders DESC, f.status LIMIT :limit", _LIMIT),
    "parties_with_status": Question("Which customers have orders in a particular state?", "SELECT p.name, f.id AS order_id FROM fact f JOIN party p ON p.tenant_id = f.tenant_id AND p.id = f.party_id WHERE f.tenant_id = :tenant AND f.status ILIKE concat('%', :term, '%') ORDER BY p.name, f.id LIMIT :limit", {"term": str, **_LIMIT}),
    "work_queue": Question("What is the queue doing, how much work is pending or failed?", "SELECT l.kind, count(*) AS leads, count_if(l.failed) AS failed FROM lead l WHERE l.tenant_id = :tenant GROUP BY l.kind ORDER BY leads DESC, l.kind LIMIT :limit", _LIMIT),
    "newest_facts": Question("What did we learn most recently?", "SELECT f.id, f.created_at, f.status FROM fact f WHERE f.tenant_id = :tenant ORDER BY f.created_at DESC, f.id LIMIT :limit", _LIMIT),
    "facts_without_builder": Question("Which orders come from no builder?", "SELECT f.id FROM fact f LEFT JOIN party p ON p.id = f.party_id AND p.tenant_id = :tenant AND p.segment = 'BUILDING' WHERE f.tenant_id = :tenant AND p.id IS NULL ORDER BY f.id LIMIT :limit", _LIMIT),
}


def tenant_views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables that questions read, each with its tenant."""
    tenant = lambda c: (F.col(c) % 25).cast("long").alias("tenant_id")
    return {
        "party": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), tenant("c_custkey"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        "fact": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), tenant("o_custkey"), F.col("o_custkey").alias("party_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("created_at")),
        "lead": table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), tenant("user_id"), F.col("event_type").alias("kind"), (F.col("value") > 90).alias("failed")),
    }


#: The tenant of each table behind these views.
TENANTS = {"customer": "c_custkey % 25", "orders": "o_custkey % 25", "events": "user_id % 25"}


def ask(spark: SparkSession, sf_dir: str, key: str, tenant: int, **slots: object) -> DataFrame:
    """A question of the catalogue for one tenant; it is proved before it runs, its statement and the plan that comes of it, and slots are typed and bound, never pasted."""
    q = QUESTIONS[key]
    if slots.keys() != q.slots.keys():
        raise ValueError(f"{key} takes {sorted(q.slots)}")
    from wrenfold.plans import scope

    prove_scoped(spark, q.sql)
    views = tenant_views(spark, sf_dir)
    named = re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", q.sql)
    used = {n: views[n] for n in re.findall(r"\b(?:FROM|JOIN) (\w+)", q.sql)}
    found = spark.sql(named, args={"tenant": int(tenant)} | {k: q.slots[k](v) for k, v in slots.items()}, **used)
    scope.prove_plan(found, int(tenant), TENANTS)
    return found


def nearest_question(text: str) -> str | None:
    """The question that shares most words with a text, by share of its own words; None if it shares none but common ones."""
    common = set("a an and are by do does for have how in is it many most much no of or our that the they to we what which with who".split())
    words = lambda t: set(re.findall("[a-z]+", t.lower())) - common
    asked = words(text)
    best = max(QUESTIONS, key=lambda k: (len(asked & words(QUESTIONS[k].asks)) / len(words(QUESTIONS[k].asks)), k))
    return best if asked & words(QUESTIONS[best].asks) else None


# Statements and whether each is scoped to tenant 7.
TRIES = (
    ("SELECT * FROM fact WHERE tenant_id = 7", True),
    ("SELECT * FROM fact", False),
    ("SELECT * FROM fact WHERE tenant_id = 8", False),
    ("SELECT * FROM fact WHERE tenant_id = coalesce(tenant_id, 7)", False),
    ("SELECT * FROM fact WHERE tenant_id IS NOT NULL", False),
    ("SELECT * FROM fact f JOIN party p ON f.party_id = p.id AND f.tenant_id = p.tenant_id WHERE f.tenant_id = 7", True),
    ("SELECT * FROM fact f JOIN party p ON f.party_id = p.id WHERE f.tenant_id = 7", False),
    ("SELECT * FROM fact f, party p WHERE f.tenant_id = 7 AND p.tenant_id = f.tenant_id", True),
    ("SELECT * FROM fact f, party p WHERE f.tenant_id = 7", False),
    ("SELECT * FROM fact f LEFT JOIN party p ON f.party_id = p.id AND f.tenant_id = 7 AND p.tenant_id = 7", False),
    ("SELECT * FROM fact f LEFT JOIN party p ON f.party_id = p.id AND p.tenant_id = 7 WHERE f.tenant_id = 7", True),
    ("SELECT * FROM fact f LEFT JOIN party p ON f.party_id = p.id AND p.tenant_id = f.tenant_id WHERE f.tenant_id = 7", True),
    ("SELECT * FROM fact f RIGHT JOIN party p ON f.party_id = p.id AND f.tenant_id = p.tenant_id WHERE p.tenant_id = 7", True),
    ("SELECT * FROM fact f RIGHT JOIN party p ON f.party_id = p.id AND p.tenant_id = 7 WHERE f.tenant_id = 7", False),
    ("SELECT * FROM fact f FULL JOIN party p ON f.tenant_id = 7 AND p.tenant_id = 7", False),
    ("SELECT * FROM fact f LEFT ANTI JOIN party p ON f.tenant_id = 7 AND p.tenant_id = 7", False),
    ("SELECT * FROM fact WHERE tenant_id = 7 OR 1 = 1", False),
    ("SELECT * FROM fact WHERE NOT tenant_id = 7", False),
    ("SELECT * FROM fact f WHERE f.tenant_id = 7 AND EXISTS (SELECT 1 FROM party p WHERE p.id = f.party_id)", False),
    ("SELECT * FROM fact f WHERE f.tenant_id = 7 AND EXISTS (SELECT 1 FROM party p WHERE p.id = f.party_id AND p.tenant_id = 7)", True),
    ("SELECT * FROM (SELECT * FROM fact WHERE tenant_id = 7) x", True),
    ("SELECT * FROM (SELECT * FROM fact) x WHERE x.tenant_id = 7", False),
    ("SELECT 1 FROM fact WHERE tenant_id = 7 UNION ALL SELECT 2 FROM fact", False),
    ("WITH x AS (SELECT * FROM fact) SELECT * FROM x WHERE tenant_id = 7", False),
    ("SELECT * FROM fact WHERE tenant_id = 7 -- AND", False),
    ("SELECT * FROM fact WHERE tenant_id = 7 AND id = '6f9619ff-8b86-d011-b42d-00c04fc964ff'", False),
    ("DELETE FROM fact WHERE tenant_id = 7", False),
)


_VIEWS = "WITH party AS (SELECT c_custkey AS id, c_custkey % 25 AS tenant_id, c_name AS name, c_mktsegment AS segment FROM customer), fact AS (SELECT o_orderkey AS id, o_custkey % 25 AS tenant_id, o_custkey AS party_id, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS created_at FROM orders), lead AS (SELECT event_id AS id, user_id % 25 AS tenant_id, event_type AS kind, value > 90 AS failed FROM events) "


@query("g01_scope_proofs", _VIEWS + " UNION ALL ".join("SELECT '" + t.replace("'", "''") + f"' AS statement, {str(ok).upper()} AS scoped, " + (f"(SELECT count(*) FROM ({t}))" if ok else "CAST(NULL AS BIGINT)") + " AS n" for t, ok in TRIES))
def scope_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements, whether each is proved to read tenant 7 alone, and how many rows those that are give."""
    views, out = tenant_views(spark, sf_dir), None
    for sql, _ in TRIES:
        try:
            prove_scoped(spark, sql, tenant=7)
        except Unscoped:
            rows = spark.range(1).select(F.lit(False).alias("scoped"), F.lit(None).cast("long").alias("n"))
        else:
            used = {n: views[n] for n in re.findall(r"(?:FROM|JOIN|,) (\w+)", sql) if n in views}
            named = re.sub(r"(FROM|JOIN|,) (party|fact|lead)\b", r"\1 {\2}", sql)
            rows = spark.sql(named, **used).agg(F.count(F.lit(1)).alias("n")).select(F.lit(True).alias("scoped"), "n")
        rows = rows.select(F.lit(sql).alias("statement"), "scoped", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def _as_sql(key: str, tenant: int, **slots: object) -> str:
    sql = QUESTIONS[key].sql
    for k, v in {"tenant": tenant, **slots}.items():
        sql = sql.replace(f":{k}", f"'{v}'" if isinstance(v, str) else str(v))
    return _VIEWS + sql


_ASKED = (("parties_by_segment", {}), ("status_spread", {"limit": 5}), ("parties_with_status", {"term": "p", "limit": 40}), ("work_queue", {"limit": 9}), ("newest_facts", {"limit": 30}), ("facts_without_builder", {"limit": 30}))
for _key, _slots in _ASKED:
    query(f"g03_{_key}", _as_sql(_key, 7, **_slots))(lambda spark, sf_dir, key=_key, slots=_slots: ask(spark, sf_dir, key, tenant=7, **slots))



@query("g02_plan_proofs", _VIEWS + " UNION ALL ".join(f"SELECT '{key}' AS question, tenant_id, (SELECT count(*) FROM ({_as_sql(key, 0, **slots).removeprefix(_VIEWS)})) AS n FROM (SELECT 0 AS tenant_id)" for key, slots in _ASKED) + " UNION ALL " + " UNION ALL ".join(f"SELECT '{key}', tenant_id, (SELECT count(*) FROM ({_as_sql(key, 7, **slots).removeprefix(_VIEWS)})) FROM (SELECT 7 AS tenant_id)" for key, slots in _ASKED))
def plan_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each question gives to two tenants; the plan of each is proved to read that tenant's rows only, or this raises."""
    out = None
    for tenant in (0, 7):
        for key, slots in _ASKED:
            rows = ask(spark, sf_dir, key, tenant, **slots).agg(F.count(F.lit(1)).alias("n")).select(F.lit(key).alias("question"), F.lit(tenant).alias("tenant_id"), "n")
            out = rows if out is None else out.unionByName(rows)
    return out


@query("g05_table_functions", """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages), t AS (SELECT page_id, href, lower(href || ' ' || substr(href, 2)) AS w FROM a)
SELECT page_id, count(*) AS links, min(href) AS first_link, CAST(count(*) FILTER (WHERE regexp_matches(w, 'contact|get-in-touch|getintouch|reach-us|submi(ssion|t)|staff|(music|program)-?director|about|people|team|music|programming|dj|connect|info')) AS BIGINT) AS contactish FROM t GROUP BY 1""")
def table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered table and scalar functions in a SQL statement."""
    F_SQL.register(spark)
    sql = "SELECT p.page_id, count(*) AS links, min(a.href) AS first_link, count(contact_tier(a.href, a.text)) AS contactish FROM {pages} p, LATERAL anchors(p.html) a GROUP BY p.page_id"
    return spark.sql(sql, pages=table(spark, sf_dir, "pages"))


@query("g05_aggregate_function", "SELECT user_id, round(least(1.0, exp(avg(ln((value + 1) / 200)))), 6) AS confidence FROM events GROUP BY 1")
def aggregate_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered aggregate in a SQL statement."""
    F_SQL.register(spark)
    return spark.sql("SELECT user_id, round(geometric_confidence(ln((value + 1) / 200)), 6) AS confidence FROM {events} GROUP BY user_id", events=table(spark, sf_dir, "events"))


@query("g04_public_projection", "SELECT c_custkey AS id, c_name AS name, n_name AS country, coalesce(k, 0) AS contacts FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def public_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named columns only: the number of contacts, never one of them."""
    k = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    rows = table(spark, sf_dir, "customer").join(k, F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("country"), F.coalesce("k", F.lit(0)).alias("contacts"))


@query("g07_needs_you", "SELECT 'order' AS kind, o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS weight FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' UNION ALL SELECT 'customer', c_custkey, -c_acctbal FROM customer WHERE c_acctbal < -500 UNION ALL SELECT 'error', user_id, CAST(count(*) AS DOUBLE) FROM events WHERE event_type = 'error' GROUP BY user_id")
def needs_you(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda df, kind, key, weight: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), weight.cast("double").alias("weight"))
    a = item(table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'"), "order", "o_orderkey", F.col("o_totalprice"))
    b = item(table(spark, sf_dir, "customer").filter("c_acctbal < -500"), "customer", "c_custkey", -F.col("c_acctbal"))
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg(count_if(F.lit(True)).alias("n"))
    return a.unionByName(b).unionByName(item(e, "error", "user_id", F.col("n")))
