"""Audit inputs rendered from the driver's TPC-H tables (FIXTURES.md, F-TPCH).

One document per order. The builder only *renders* rows in the shapes the
audit jobs expect -- document text, gold map, recorded raw answers of the two
extraction paths and an answer book for the arbiter -- using key arithmetic
(``pmod``) so an independent SQL engine can mirror every rule. It does none of
the audit work: parsing, canonicalisation, flagging, resolution and grounding
all run later, on the raw text, through the library's jobs.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize_dealt, shuffle_partitions
from ..spec import FieldSpec, Schema

# TPC-H order priorities in declared order (the enum domain),
# invented answers used by the rules below.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
FABRICATED_NATION = "Freedonia"
THIRD_NATION = "Atlantis"
THIRD_CUSTOMER = "Unlisted Customer"
THIRD_SUPPLIER = "Unlisted Supplier"
WRONG_CUSTOMER = "customer#999999999"
# Ways in which a free-form answer writes an amount, says that nothing is stated,
# and writes a date; the order's key picks one.
CURRENCIES = ("USD ", "EUR ", "$", "£", "MYR ", "RM ")
ABSENT = ("none", "N/A", "na", "NULL", "not provided", "Not specified", "not stated", "not applicable",
          "value not mentioned", "unknown")
RUN_ID = "tpch"

ORDERS_SCHEMA = Schema("orders_audit", (
    FieldSpec("order_id", "string", description="order number, ORD-<n>"),
    FieldSpec("customer", "string", description="customer name"),
    FieldSpec("total", "number", description="total amount due"),
    FieldSpec("order_date", "date", required=False, description="date the order was placed"),
    FieldSpec("priority", "enum", enum=PRIORITIES),
    FieldSpec("nation", "string", required=False, description="destination nation"),
    FieldSpec("suppliers", "string", multi=True, description="supplier names"),
))


class PageClient:
    """A client for recorded pages: it reads the asked field off the line that holds it, and fails for the orders
    ``k % every = 8``, by a timeout if k is even."""

    LINES = {"order_id": r"Order number: (\S+)", "customer": "Customer: (.*)", "total": "TOTAL DUE: (.*)", "order_date": r"Order placed on (.*)\. Payment",
             "priority": "Priority: (.*)", "nation": r"Destination nation: (.*)\.", "suppliers": "Suppliers: (.*)"}

    def __init__(self, every: int):
        self.every = every

    def generate(self, prompt: str, force_json: bool = False) -> str:
        k = int(re.search(r"Order number: ORD-(\d+)", prompt)[1])
        if k % self.every == 8:
            raise ValueError(f"no page {k}") if k % 2 else TimeoutError("page")
        found = re.search(self.LINES[re.search("FIELD: (.*)", prompt)[1]], prompt)
        return found[1] if found else "NONE"


@dataclass
class AuditInputs:
    """The four tables an audit run reads."""
    documents: DataFrame    # doc_id, doc_idx, document, gold MAP<STRING,STRING>
    extractions: DataFrame  # run_id, doc_id, constrained_raw, unconstrained_raw
    answer_book: DataFrame  # run_id, doc_id, field, raw   (arbiter answers, every field)
    schema: Schema
    run_ids: tuple[str, ...] | None = None  # runs that every document belongs to; None: those of extractions


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pm(k: Column, m: int) -> Column:
    return F.pmod(k, F.lit(m))


def order_suppliers(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """(l_orderkey, names ARRAY<STRING>): names of all distinct suppliers of
    each order, in key order.

    Distinct (order, supplier) pairs first, so the collected list is what one
    document of the order states. Line items are dealt by order once, which
    serves the distinct pairs, the lists and the join with the orders.
    """
    dealt = lineitem.select("l_orderkey", "l_suppkey").repartition(shuffle_partitions(lineitem.sparkSession), "l_orderkey")
    pairs = dealt.distinct()
    named = pairs.join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    return named.groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_suppkey", "s_name"))),
                    lambda x: x["s_name"]).alias("names"))


def tpch_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with everything the renderings need."""
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), "o_custkey", "o_totalprice",
        F.to_date("o_orderdate").alias("odate"), "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    # 25 rows by the TPC-H definition: a bounded broadcast.
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    supp = order_suppliers(read_table(spark, sf_dir, "lineitem"),
                           read_table(spark, sf_dir, "supplier"))
    # dealt as the line items are, and as the rendered rows are written
    return (orders.join(customer, "o_custkey", "left")
            .join(nation, "c_nationkey", "left").repartition(shuffle_partitions(spark), "k")
            .join(supp, orders["k"] == supp["l_orderkey"], "left")
            .select("k", "o_custkey", "o_totalprice", "odate", "o_orderpriority",
                    "c_name", "n_name",
                    F.coalesce("names", F.array().cast("array<string>")).alias("names")))


def _renderings(o: DataFrame) -> DataFrame:
    k = F.col("k")
    prio = F.array(*[F.lit(p) for p in PRIORITIES])
    pidx = F.array_position(prio, F.col("o_orderpriority")).cast("int") - 1
    words = lambda d: F.date_format(d, "d MMMM yyyy")
    money = lambda x: F.format_number(x, 2)
    return o.select(
        "*",
        F.concat(F.lit("ORD-"), k.cast("string")).alias("g_order_id"),
        F.format_string("%.2f", F.col("o_totalprice")).alias("g_total"),
        F.date_format("odate", "yyyy-MM-dd").alias("g_date"),
        words(F.col("odate")).alias("date_words"),
        words(F.date_add("odate", 30)).alias("due_words"),
        F.when(_pm(k, 10) < 7, F.col("n_name")).otherwise(F.lit("")).alias("g_nation"),
        ((_pm(k, 10) >= 7) & (_pm(k, 3) == 0)).alias("fabricated"),
        F.array_join("names", "; ").alias("g_suppliers"),
        F.element_at(prio, F.pmod(pidx + 1, F.lit(5)) + 1).alias("next_prio"),
        F.element_at(prio, F.pmod(pidx + 2, F.lit(5)) + 1).alias("third_prio"),
        money(F.col("o_totalprice")).alias("total_words"),
        money(F.col("o_totalprice") - F.lit(11.11)).alias("subtotal_words"),
    )


def _constrained(r: DataFrame) -> dict[str, Column]:
    k = F.col("k")
    return {
        "order_id": F.when(_pm(k, 19) == 6, F.substring("g_order_id", 1, 3))
                     .otherwise(F.col("g_order_id")),
        "customer": F.col("c_name"),
        "total": F.when(_pm(k, 29) == 7, F.lit(None).cast("decimal(18,2)"))
                  .when(_pm(k, 11) == 3, (F.col("o_totalprice") + F.lit(100.0)).cast("decimal(18,2)"))
                  .otherwise(F.col("o_totalprice").cast("decimal(18,2)")),
        "order_date": F.when(_pm(k, 13) == 4,
                             F.date_format(F.date_add("odate", 1), "yyyy-MM-dd"))
                       .otherwise(F.col("g_date")),
        "priority": F.when(_pm(k, 17) == 5, F.col("next_prio")).otherwise(F.col("o_orderpriority")),
        "nation": F.when(F.col("g_nation") != "", F.col("g_nation"))
                   .when(F.col("fabricated"), F.lit(FABRICATED_NATION)),
        "suppliers": F.when(_pm(k, 23) == 8, F.slice("names", F.lit(2), F.size("names"))).otherwise(F.col("names")),
    }


def _constrained_raw(con: dict[str, Column]) -> Column:
    k = F.col("k")
    js = F.to_json(F.struct(*[c.alias(n) for n, c in con.items()]))
    truncated = F.substring(js, F.lit(1), (F.length(js) / 2).cast("int"))
    fenced = F.concat(F.lit("```json\n"), js, F.lit("\n```"))
    return (F.when(_pm(k, 97) == 0, truncated).when(_pm(k, 4) == 0, fenced).otherwise(js))


def _pick(options: tuple[str, ...], by: Column | None = None) -> Column:
    by = F.col("k") if by is None else by
    return F.element_at(F.array(*map(F.lit, options)), (_pm(by, len(options)) + 1).cast("int"))


def _written_date() -> Column:
    """The order's date in one of ten ways; month before day only where it can't be read the other way."""
    d = F.col("odate")
    plain = F.col("date_words")
    ways = [F.date_format(d, "yyyy-MM-dd"), plain, F.date_format(d, "MMMM d yyyy"), F.date_format(d, "dd/MM/yyyy"),
            F.when(F.dayofmonth(d) > 12, F.date_format(d, "MM/dd/yyyy")).otherwise(plain), F.date_format(d, "dd-MM-yyyy"),
            F.date_format(d, "MMM d yyyy"), F.date_format(d, "d MMM yyyy"), F.concat(plain, F.lit(" 14:05")),
            F.concat(F.date_format(d, "d"), F.lit("th day of "), F.date_format(d, "MMMM"), F.lit(", "), F.date_format(d, "yyyy"))]
    return F.element_at(F.array(*ways), (_pm(F.col("k"), 10) + 1).cast("int"))


def _unconstrained_raw() -> Column:
    k = F.col("k")
    nation = (F.when(F.col("g_nation") != "", F.col("g_nation"))
              .when(F.col("fabricated"), F.lit(FABRICATED_NATION))
              .otherwise(_pick(ABSENT, (F.col("k") / 10).cast("long"))))
    customer = F.when(_pm(k, 37) == 11, F.lit(WRONG_CUSTOMER)).otherwise(F.lower("c_name"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("- **order_id**: "), F.col("g_order_id")),
        F.concat(F.lit("customer:   "), customer, F.lit(" .")),
        F.concat(F.lit("* TOTAL: "), _pick(CURRENCIES), F.col("total_words")),
        F.concat(F.lit("order_date: "), _written_date()),
        F.concat(F.lit("> priority: "), F.col("o_orderpriority")),
        F.concat(F.lit("nation: "), nation),
        F.concat(F.lit("suppliers: "), F.array_join(F.reverse("names"), "; ")),
    )


def _document() -> Column:
    k = F.col("k")
    return F.concat_ws(
        "\n",
        F.lit("ORDER CONFIRMATION"),
        F.concat(F.lit("Order number: "), F.col("g_order_id"), F.lit("    Reference: PO-"),
                 (k * 7 + 1000).cast("string")),
        F.concat(F.lit("Customer: "), F.col("c_name")),
        F.when(_pm(k, 31) != 9, F.concat(F.lit("Order placed on "), F.col("date_words"),
                                         F.lit(". Payment due "), F.col("due_words"), F.lit("."))),
        F.when(F.col("g_nation") != "",
               F.concat(F.lit("Destination nation: "), F.col("g_nation"), F.lit("."))),
        F.concat(F.lit("Priority: "), F.col("o_orderpriority")),
        F.concat(F.lit("Suppliers: "), F.when(F.size("names") == 0, F.lit("none listed"))
                 .otherwise(F.array_join("names", ", "))),
        F.concat(F.lit("Subtotal: USD "), F.col("subtotal_words")),
        F.concat(F.lit("TOTAL DUE: USD "), F.col("total_words")),
    )


def _answers(con: dict[str, Column]) -> list[tuple[str, Column]]:
    """Arbiter answer per field: third value, the constrained value, or padded gold."""
    con_text = {
        n: (F.coalesce(F.array_join(c, "; "), F.lit("")) if n == "suppliers"
            else F.coalesce(c.cast("string"), F.lit("")))
        for n, c in con.items()}
    third = {
        "order_id": F.concat(F.lit("ORD-X"), F.col("k").cast("string")),
        "customer": F.lit(THIRD_CUSTOMER),
        "total": F.lit("The total is 1.00."),
        "order_date": F.date_format(F.date_add("odate", 200), "d MMMM yyyy"),
        "priority": F.col("third_prio"),
        "nation": F.lit(THIRD_NATION),
        "suppliers": F.lit(THIRD_SUPPLIER),
    }
    gold = {
        "order_id": F.concat(F.lit('"'), F.col("g_order_id"), F.lit('".')),
        "customer": F.concat(F.col("c_name"), F.lit(".")),
        "total": F.concat(F.lit("The total is "), F.col("total_words"), F.lit(".")),
        "order_date": F.concat(F.col("date_words"), F.lit(".")),
        "priority": F.concat(F.lit("The priority is "), F.col("o_orderpriority"), F.lit(".")),
        "nation": F.when(F.col("g_nation") != "", F.col("g_nation")).otherwise(F.lit("NONE")),
        "suppliers": F.col("g_suppliers"),
    }
    out = []
    for i, f in enumerate(ORDERS_SCHEMA.fields):
        k2 = F.col("k") + F.lit(i)
        out.append((f.name, F.when(_pm(k2, 5) == 1, third[f.name])
                    .when(_pm(k2, 7) == 2, con_text[f.name])
                    .otherwise(gold[f.name])))
    return out


def tpch_audit_inputs(spark: SparkSession, sf_dir: str) -> AuditInputs:
    """Render the F-TPCH audit inputs from ``sf_dir``.

    Every 101st order has no response (k % 101 = 17) and every 103rd no recorded
    arbiter answer (k % 103 = 29). The rendered rows are written once to the
    shared folder, in buckets of the document's id; the three tables are projections of what was written.
    """
    r = _renderings(tpch_orders(spark, sf_dir))
    con = _constrained(r)
    k = F.col("k")
    gold = F.create_map(
        F.lit("order_id"), F.col("g_order_id"), F.lit("customer"), F.col("c_name"),
        F.lit("total"), F.col("g_total"), F.lit("order_date"), F.col("g_date"),
        F.lit("priority"), F.col("o_orderpriority"), F.lit("nation"), F.col("g_nation"),
        F.lit("suppliers"), F.col("g_suppliers"))
    answers = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("raw")) for n, c in _answers(con)])
    rendered = materialize_dealt(r.select(
        k.alias("doc_id"), _document().alias("document"), gold.alias("gold"), _constrained_raw(con).alias("constrained_raw"),
        _unconstrained_raw().alias("unconstrained_raw"), answers.alias("answers"),
        (_pm(k, 101) != 17).alias("responded"), (_pm(k, 103) != 29).alias("answered")), "rendered", "doc_id")
    run = F.lit(RUN_ID).alias("run_id")
    documents = rendered.select("doc_id", F.col("doc_id").alias("doc_idx"), "document", "gold")
    extractions = rendered.filter("responded").select(run, "doc_id", "constrained_raw", "unconstrained_raw")
    answer_book = rendered.filter("answered").select(run, "doc_id", F.inline("answers"))
    return AuditInputs(documents, extractions, answer_book, ORDERS_SCHEMA, (RUN_ID,))
