"""Event, vocabulary and note views derived from the given tables (whole tables, no subsets)."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longfeat.functions.columns import flag
from longfeat.functions.joins import BROADCAST_BYTES, fits
from longfeat.operators.measures import Bound

ROUTES = {
    "click": (0, 1, 2, 3),
    "view": (2, 3, 4, 5),
    "error": (4, 5, 6, 7),
    "purchase": (6, 7, 8, 9),
    "signup": (1, 8),
}
EXEMPT = {"click": ("set3",)}
INDICATORS = [f"ind{i}" for i in range(10)]
AS_OF = "2024-06-30"

# The measure view has concepts 0..23: laboratory measures, two tests, body measures.
BOUNDS = [
    Bound("m4", (4,), 5, 40),
    Bound("m5", (5,), 1, 25),
    Bound("m6", (6, 7), 10, 50),
    Bound("m8", (8,), 20, 30),
    Bound("m9", (9,), 2, 49),
    Bound("m10", (10, 11, 12), 0, 45),
]
ROLE_SETS = {
    "bmi": "set_bmi",
    "weight": "set_weight",
    "height": "set_height",
    "test_a": "set_test_a",
    "test_b": "set_test_b",
    "pos": "set_pos",
    "neg": "set_neg",
}
TESTS, RESULTS = ["test_a", "test_b"], ["pos", "neg"]
EXPOSURE_PRODUCTS = {c: ("a" if c < 30 else "b" if c < 60 else "c") for c in range(80)}
PROCEDURE_PRODUCTS = {10: "a", 40: "b", 70: "c"}
EXCLUDED_TYPES = (3, 5)
CUSTOM_SETS = [
    (7, "seven", "custom_odd"),
    (9, "nine", "custom_odd"),
    (8, "eight", "custom_even"),
    (7, "seven", "custom_odd"),
    (55, "fifty-five", "custom_five"),
]
CUSTOM_REGISTRY = [
    ("custom_odd", "ODD", "view"),
    ("custom_even", "EVEN", "click, view"),
    ("custom_absent", "ABSENT", "error"),
]


class Views:
    """Lazy views over one data directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.opened: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self.opened:
            self.opened[name] = self.spark.read.parquet(f"{self.root.rstrip('/')}/{name}.parquet")
        return self.opened[name]

    @cached_property
    def small(self) -> bool:
        """Size check of the vocabulary views, which bound every lookup made from them.

        Their own distinct rows count: the part dimension they come from grows while the vocabulary does not.
        """
        views = [self.members(), self.measure_members(), self.mention_members()]
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), views)
        return fits(stacked, BROADCAST_BYTES // len(ROUTES))

    # events
    def occ(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("person_id"),
            F.col("ts").cast("date").alias("day"),
            F.col("event_type").alias("domain"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("concept_id"),
            "value",
            "event_id",
        )

    def domain(self, name: str) -> DataFrame:
        return self.occ().where(F.col("domain") == name).drop("domain")

    def users(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("person_id")).distinct()

    # vocabulary, from the part dimension
    def members(self) -> DataFrame:
        concept = (F.col("p_partkey") % 100).alias("concept_id")
        concepts = self.table("part").select(concept).distinct()
        tens = F.floor(F.col("concept_id") / 10)
        current = F.when(F.col("concept_id") % 10 == 9, "false").when(F.col("concept_id") % 10 == 8, "T")
        return concepts.select(
            (tens + 100).alias("codeset_id"),
            "concept_id",
            F.concat(F.lit("set"), tens.cast("string")).alias("set_name"),
            current.otherwise("true").alias("is_current"),
            F.lit(1).alias("version"),
            F.concat(F.lit("concept "), F.col("concept_id").cast("string")).alias("concept_name"),
            F.lit("false").alias("archived"),
        )

    def registry(self) -> DataFrame:
        """Sets 0..9 as ind0..ind9; each domain routes some of them, with overlaps."""
        n = F.col("n")
        words = [F.when(n.isin(*sets), F.lit(name)) for name, sets in ROUTES.items()]
        sets = self.table("part").select((F.col("p_partkey") % 10).alias("n")).distinct()
        return sets.select(
            F.concat(F.lit("set"), n.cast("string")).alias("set_name"),
            F.concat(F.lit("ind"), n.cast("string")).alias("indicator"),
            F.concat_ws(", ", *words).alias("domain"),
        )

    def measure_members(self) -> DataFrame:
        """Concept sets of the measure roles, from the part dimension (concepts 0..23 and result codes 1..3)."""
        concept = (F.col("p_partkey") % 24).alias("concept_id")
        c = F.col("concept_id")
        concepts = self.table("part").select(concept).distinct()
        subject = (
            F.when(c == 23, "set_bmi")
            .when(c == 22, "set_weight")
            .when(c == 21, "set_height")
            .when(c.between(0, 1), "set_test_a")
            .when(c.between(2, 3), "set_test_b")
        )
        result = F.when(c == 1, "set_pos").when(c == 2, "set_neg")
        both = F.explode(F.array(subject, result)).alias("set_name")
        named = concepts.select("concept_id", both).where(F.col("set_name").isNotNull())
        return named.withColumn("is_current", F.lit("true"))

    # persons
    def person(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("person_id"),
            (1930 + key % 90).cast("int").alias("year_of_birth"),
            (key % 14).cast("int").alias("month_of_birth"),
            (key % 31).cast("int").alias("day_of_birth"),
            F.col("c_mktsegment").alias("segment"),
        )

    def enc(self) -> DataFrame:
        undated = F.col("o_orderkey") % 50 == 0
        return self.table("orders").select(
            F.col("o_custkey").alias("person_id"),
            F.when(~undated, F.col("o_orderdate").cast("date")).alias("day"),
            F.col("o_orderkey").alias("encounter_id"),
        )

    def cohort(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("person_id"))

    def meas(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("person_id"))
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("o_orderkey"),
            F.col("l_shipdate").cast("date").alias("day"),
            (F.col("l_partkey") % 24).alias("concept_id"),
            F.when(
                F.col("l_linenumber") < 7,
                F.when(F.col("l_partkey") % 24 == 21, F.col("l_quantity") / 20.0).otherwise(F.col("l_quantity")),
            ).alias("value"),
            F.when(F.col("l_returnflag") == "R", 1)
            .when(F.col("l_returnflag") == "N", 2)
            .otherwise(3)
            .cast("bigint")
            .alias("result_concept_id"),
        )
        return lines.join(orders, "o_orderkey").select("person_id", "day", "concept_id", "value", "result_concept_id")

    # doses, episodes, outcomes
    def exposures(self) -> DataFrame:
        type_id = F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 7).alias("type_id")
        return self.domain("signup").select("person_id", "day", "concept_id", type_id)

    def procedures(self) -> DataFrame:
        return self.domain("error").select("person_id", "day", "concept_id")

    def episodes(self) -> DataFrame:
        buys = self.domain("purchase")
        end = F.when(F.col("event_id") % 13 != 0, F.date_add("day", 2)).alias("end_day")
        return buys.where(F.col("value") > 40).select("person_id", F.col("day").alias("start_day"), end)

    def labels(self) -> DataFrame:
        """Per user: prior = any purchase above 100, after = any error above 150 (null for every 10th user)."""
        high = lambda kind, v: F.max(flag((F.col("domain") == kind) & (F.col("value") > v)))
        seen = self.occ().groupBy("person_id").agg(high("purchase", 100).alias("prior"), high("error", 150).alias("after"))
        return seen.withColumn("after", F.when(F.col("person_id") % 10 != 0, F.col("after")))

    # notes
    def notes(self) -> DataFrame:
        """Ten events to a note, and a note without mentions for each order."""
        note = (-F.col("encounter_id")).alias("note_id")
        return self.event_notes().unionByName(self.enc().select(note, "person_id", "day", (note % 7).alias("visit_id")))

    def event_notes(self) -> DataFrame:
        return (
            self.occ()
            .groupBy(F.floor(F.col("event_id") / 10).alias("note_id"))
            .agg(F.min("person_id").alias("person_id"), F.min("day").alias("day"))
            .withColumn("visit_id", F.col("note_id") % 7)
        )

    def mentions(self) -> DataFrame:
        """Events as mentions; every 17th has no concept."""
        sign = F.when(F.col("domain").isin("click", "view"), "Positive").when(F.col("domain") == "error", "Negated")
        concept = F.when(F.col("event_id") % 17 != 0, F.floor(F.col("concept_id") / 5)).alias("concept_id")
        return (
            self.occ()
            .select(
                F.col("event_id").alias("mention_id"),
                F.floor(F.col("event_id") / 10).alias("note_id"),
                sign.otherwise("Unknown").alias("certainty"),
                concept,
            )
        )

    def broad_sets(self) -> DataFrame:
        """Broad sets over the first four member codesets, and one without members."""
        n = F.col("n")
        return self.table("part").select((F.col("p_partkey") % 10).alias("n")).distinct().where(n < 5).select(
            F.when(n == 4, F.lit(999)).otherwise(n + 100).cast("bigint").alias("codeset_id"),
            F.concat(F.lit("broad-"), n.cast("string")).alias("set_name"),
        )

    def mention_members(self) -> DataFrame:
        """Members for mention concepts 0..19: five per codeset; concept 0 is the placeholder."""
        c = F.col("concept_id")
        name = F.when(c == 0, "No matching concept").otherwise(F.concat(F.lit("concept, "), c.cast("string")))
        return self.table("part").select((F.col("p_partkey") % 20).alias("concept_id")).distinct().select(
            (F.floor(c / 5) + 100).alias("codeset_id"), "concept_id", name.alias("concept_name")
        )
