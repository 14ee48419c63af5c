"""The registered Spark queries: name -> (spark, data directory) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longfeat.operators import boosting
from longfeat.operators import cohort as co
from longfeat.operators import dayfacts as df_
from longfeat.operators import doses as do
from longfeat.operators import indicators as ind
from longfeat.operators import labels as la
from longfeat.operators import learn, lookback, mentions, metrics, summary, topk
from longfeat.operators import measures as me
from longfeat.operators import sequences as seq
from longfeat.operators import vocabulary as vo
from longfeat.plans import products
from longfeat.plans.defaults import MEASURE_BOUNDS
from longfeat.sources import layout, schemas, storage, tables
from workload import views as vw
from workload.views import Views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    """Register a function of the views under its own name."""
    QUERIES[fn.__name__] = lambda spark, root: fn(Views(spark, root))
    return fn


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# sources and sinks
@query
def source_subset(v: Views) -> DataFrame:
    return tables.first_rows(v.enc(), 500, ties=["encounter_id"])


@query
def source_subset_persons(v: Views) -> DataFrame:
    kept = tables.subset({"enc": v.enc(), "meas": v.meas()}, 100, of="enc")
    counts = kept["meas"].groupBy("person_id").agg(F.count(F.lit(1)).alias("measures"))
    return kept["enc"].join(counts, "person_id", "left").select("person_id", "encounter_id", "day", "measures")


@query
def source_conform(v: Views) -> DataFrame:
    text = v.table("orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.substring("o_orderpriority", 1, 1).alias("rank"),
        F.col("o_orderstatus").alias("bad"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.col("o_orderdate").cast("date").cast("string").alias("day"),
    )
    return tables.conform(text, "id bigint, rank int, bad int, price double, day date")


def written_orders(v: Views) -> DataFrame:
    """Orders as text, with values that do not parse."""
    day = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    return v.table("orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("o_orderkey") % 7 == 0, "none").otherwise(F.substring("o_orderpriority", 1, 1)).alias("rank"),
        F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("about "), F.col("o_totalprice").cast("string")))
        .when(F.col("o_orderkey") % 13 > 0, F.col("o_totalprice").cast("string"))
        .alias("price"),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(day, F.lit("?"))).otherwise(day).alias("day"),
    )


ORDER_FIELDS = "id bigint, rank int, price double, day date"


@query
def source_refused(v: Views) -> DataFrame:
    """Counts of values that do not parse, per column."""
    return tables.refused(written_orders(v), ORDER_FIELDS, "orders")


@query
def source_strict(v: Views) -> DataFrame:
    """A file with values that do not parse: its rows that fit, and the ids of the lines refused."""
    root = storage.fresh_path(v.spark, "refused")
    storage.write_table(written_orders(v), root, "csv")
    fine, lines = storage.load_strict(v.spark, root, ORDER_FIELDS)
    gone = lines.select(F.regexp_extract("line", "^[0-9]+", 0).cast("bigint").alias("id")).withColumn("refused", F.lit(1))
    return fine.withColumn("refused", F.lit(0)).unionByName(gone, allowMissingColumns=True)


@query
def sink_roundtrip(v: Views) -> DataFrame:
    root = storage.fresh_path(v.spark, "csv")
    storage.write_table(v.enc(), f"{root}/enc.csv", "csv")
    return tables.load_tables(v.spark, root, {"enc": "person_id bigint, day date, encounter_id bigint"})["enc"]


def layout_tables(v: Views) -> dict[str, DataFrame]:
    """Tables of the published layout from the given ones; an extra column stands first, as files may have them."""
    coded = lambda domain, prefix, day="date": v.domain(domain).select(
        F.lit("x").alias("extra"), "person_id", F.col("day").alias(f"{prefix}_{day}"), F.col("concept_id").alias(f"{prefix}_concept_id")
    )
    return {
        "condition": coded("click", "condition", "start_date"),
        "observation": coded("view", "observation"),
        "procedure": coded("error", "procedure"),
        "drug": coded("purchase", "drug", "exposure_start_date").withColumnRenamed("drug_exposure_concept_id", "drug_concept_id"),
        "measurement": v.meas().select("person_id", F.col("concept_id").alias("measurement_concept_id"), F.col("value").alias("value_as_number")),
        "person": v.person(),
        "encounter": v.enc().select("person_id", F.col("day").alias("visit_start_date")),
        "label": v.labels().select("person_id", F.col("after").alias("pasc_code_after_four_weeks")),
        "members": v.members().withColumnRenamed("set_name", "concept_set_name"),
        "registry": v.registry().withColumnsRenamed({"set_name": "concept_set_name", "indicator": "indicator_prefix"}),
    }


@query
def layout_roundtrip(v: Views) -> DataFrame:
    """Write a whole table set in the published layout, read it back as it is, and count rows and persons per table."""
    root = storage.fresh_path(v.spark, "layout")
    made = layout_tables(v)
    for part, folder in schemas.FOLDERS.items():
        files = schemas.VOCABULARY_FILES if part == "vocabulary" else schemas.PERSON_FILES
        for name, spec in tables.declared(files).items():
            if name in made:
                frame = made[name]
            else:  # a table the given data has no rows for
                frame = v.spark.createDataFrame([], schemas.struct(spec))
            storage.write_table(frame, f"{root}/{folder}/{files[name]}.csv", "csv")
    rows = []
    for part, read in tables.load_layout(v.spark, root).items():
        for name, frame in read.items():
            key = "person_id" if "person_id" in frame.columns else frame.columns[0]
            rows.append(frame.agg(F.lit(part).alias("part"), F.lit(name).alias("name"), F.count("*").alias("rows"), F.countDistinct(key).alias("keys")))
    return reduce(DataFrame.unionByName, rows)


@query
def stats_roundtrip(v: Views) -> DataFrame:
    path = storage.fresh_path(v.spark, "stats")
    storage.save_stats(seq.feature_stats(measure_frame(v), ["m4", "m5", "m6"]), path)
    return storage.load_stats(v.spark, path)


# vocabulary
@query
def vocab_custom_sets(v: Views) -> DataFrame:
    return vo.append_sets(v.members(), vw.CUSTOM_SETS)


@query
def vocab_registry_merge(v: Views) -> DataFrame:
    return vo.merge_registries(v.registry(), vo.append_registry(v.registry(), vw.CUSTOM_REGISTRY))


@query
def vocab_resolve(v: Views) -> DataFrame:
    return resolved(v)


@query
def vocab_roles(v: Views) -> DataFrame:
    return roles(v)


@query
def vocab_expand(v: Views) -> DataFrame:
    return vo.expand_sets(v.members(), v.broad_sets())


@query
def vocab_unmatched(v: Views) -> DataFrame:
    registry = vo.append_registry(v.registry(), vw.CUSTOM_REGISTRY)
    return vo.unmatched_sets(registry, vo.append_sets(v.members(), vw.CUSTOM_SETS))


def resolved(v: Views) -> DataFrame:
    return vo.resolve_domains(v.registry(), v.members(), {d: vw.EXEMPT.get(d, ()) for d in vw.ROUTES})


def resolved_one(v: Views, domain: str) -> DataFrame:
    return vo.resolve_concepts(v.registry(), v.members(), domain, vw.EXEMPT.get(domain, ()))


def roles(v: Views) -> DataFrame:
    return vo.concepts_in_roles(v.measure_members(), vw.ROLE_SETS)


# cohort
@query
def cohort_demographics(v: Views) -> DataFrame:
    people = co.demographics(co.distinct_persons(v.person(), [*co.BIRTH_PARTS, "segment"]), vw.AS_OF)
    people = co.one_hot(people, "segment", {"BUILDING": "is_building", "MACHINERY": "is_machinery"}, "is_other")
    people = co.bucket(people, "segment", {"goods": ["FURNITURE", "HOUSEHOLD"], "works": ["BUILDING"]}, "segment_group")
    return people.drop(*co.BIRTH_PARTS)


@query
def cohort_sample(v: Views) -> DataFrame:
    return co.hash_sample(v.cohort(), 0.25)


@query
def cohort_encounters(v: Views) -> DataFrame:
    return co.build_cohort(v.person(), v.enc(), vw.AS_OF)


@query
def cohort_scaled(v: Views) -> DataFrame:
    people = co.build_cohort(v.person(), v.enc(), vw.AS_OF)
    return rounded(co.min_max_scale(people, "age", "age_scaled").select("person_id", "age", "age_scaled"), "age_scaled")


# indicators
def days_of(v: Views, domain: str) -> DataFrame:
    return ind.indicator_days(v.domain(domain), v.cohort(), resolved_one(v, domain), vw.INDICATORS, small_fits=v.small)


@query
def indicator_days_condition(v: Views) -> DataFrame:
    return days_of(v, "click")


@query
def indicator_days_observation(v: Views) -> DataFrame:
    return days_of(v, "view")


@query
def indicator_days_procedure(v: Views) -> DataFrame:
    return days_of(v, "error")


@query
def indicator_days_drug(v: Views) -> DataFrame:
    return days_of(v, "purchase")


@query
def indicator_days_device(v: Views) -> DataFrame:
    return days_of(v, "signup")


@query
def indicator_days_indexed(v: Views) -> DataFrame:
    return ind.relative_to_index(days_of(v, "purchase"), ind.index_dates(days_of(v, "click"), "ind0"))


@query
def index_date(v: Views) -> DataFrame:
    return ind.index_dates(days_of(v, "click"))


# measures
def measure_frame(v: Views, **kw) -> DataFrame:
    return me.measure_days(v.meas(), v.cohort(), vw.BOUNDS, roles(v), vw.TESTS, vw.RESULTS, small_fits=v.small, **kw)


@query
def measure_days(v: Views) -> DataFrame:
    return me.measure_days(v.meas(), v.cohort(), vw.BOUNDS)


@query
def measure_days_default(v: Views) -> DataFrame:
    """All default measures: each gets its own concept, and values around its accepted range."""
    bounds = [me.Bound(*b) for b in MEASURE_BOUNDS]
    of = lambda f: F.element_at(F.array(*[F.lit(f(b)) for b in bounds]), F.col("concept_id").cast("int") + 1)
    low, high = of(lambda b: float(b.lo)), of(lambda b: float(b.hi))
    value = low + (high - low) * (F.col("value") - 5) / 40.0
    meas = v.meas().withColumns({"value": value, "concept_id": of(lambda b: b.concept_ids[-1])})
    return rounded(me.measure_days(meas, v.cohort(), bounds), *[b.name for b in bounds])


@query
def measure_bmi(v: Views) -> DataFrame:
    return measure_frame(v).select("person_id", "day", "bmi_rounded", "obese")


def flags_frame(v: Views, small: bool) -> DataFrame:
    people = v.person().select("person_id", "segment")
    is_building = ind.flag(F.col("segment") == "BUILDING")
    days = me.measure_days(
        v.meas(), people, [], roles(v), vw.TESTS, vw.RESULTS, attributes={"is_building": is_building}, small_fits=small
    )
    return days.drop("bmi_rounded", "obese")


@query
def measure_flags(v: Views) -> DataFrame:
    return flags_frame(v, v.small)


@query
def measure_flags_salted(v: Views) -> DataFrame:
    """The way beyond the broadcast bound."""
    return flags_frame(v, False)


# doses
def all_doses(v: Views) -> DataFrame:
    exposures = do.dose_events(
        v.exposures(), vw.EXPOSURE_PRODUCTS, "2024-01-02", vw.EXCLUDED_TYPES, v.members(), small_fits=v.small
    )
    procedures = do.dose_events(v.procedures(), vw.PROCEDURE_PRODUCTS, "2024-01-02", listed_only=True)
    return do.resolve_same_day(do.union_doses(exposures, procedures))


@query
def dose_resolved(v: Views) -> DataFrame:
    return all_doses(v)


@query
def dose_codeset(v: Views) -> DataFrame:
    doses = do.dose_events(
        v.exposures(), vw.EXPOSURE_PRODUCTS, "2024-01-02", vw.EXCLUDED_TYPES, v.members(), 104, "2024-01-20"
    )
    return do.union_doses(doses)


@query
def dose_gaps(v: Views) -> DataFrame:
    return do.drop_close(all_doses(v))


@query
def dose_counts(v: Views) -> DataFrame:
    return do.dose_counts(do.drop_close(all_doses(v)))


@query
def dose_wide(v: Views) -> DataFrame:
    return do.dose_wide(do.drop_close(all_doses(v)))


def facts_of_doses(v: Views) -> DataFrame:
    return do.dose_facts(do.dose_wide(do.drop_close(all_doses(v))), max_doses=3)


@query
def dose_facts(v: Views) -> DataFrame:
    return facts_of_doses(v)


def dose_day_frame(v: Views) -> DataFrame:
    return do.dose_days(facts_of_doses(v), v.cohort(), ind.index_dates(days_of(v, "click")), ["a", "b"])


@query
def dose_days(v: Views) -> DataFrame:
    return dose_day_frame(v)


# day facts
def facts(v: Views, **kw) -> DataFrame:
    return products.person_days(
        v.enc(),
        {d: v.domain(d) for d in ("click", "view", "error", "purchase")},
        resolved(v),
        vw.INDICATORS,
        cohort=v.cohort(),
        measures=v.meas(),
        bounds=vw.BOUNDS,
        roles=roles(v),
        tests=vw.TESTS,
        results=vw.RESULTS,
        doses=dose_day_frame(v),
        episodes=v.episodes(),
        small_fits=v.small,
        **kw,
    )


@query
def day_facts(v: Views) -> DataFrame:
    return facts(v)


@query
def day_facts_parts(v: Views) -> DataFrame:
    """Merge of collapsed parts that share indicator columns, with a notes part."""
    pivot = note_signs(v).drop("note_id", "visit_id").withColumnRenamed("sympt_broad_1", "ind1")
    return df_.day_facts(v.enc(), [days_of(v, "click"), days_of(v, "view"), pivot], keep_null=["sympt_broad_2"])


@query
def episode_flag(v: Views) -> DataFrame:
    return df_.in_episode(v.occ().select("person_id", "day").distinct(), v.episodes())


# summary
def summary_frame(v: Views) -> DataFrame:
    return summarised(facts(v), co.build_cohort(v.person(), v.enc(), vw.AS_OF))


def summarised(days: DataFrame, cohort: DataFrame) -> DataFrame:
    return summary.person_summary(
        days,
        cohort,
        {"bmi_rounded": "bmi_max"},
        {"m8": "m8_mean"},
        {"had_dose": "total_doses"},
        ["in_episode", "m4", "m5"],
    )


@query
def person_summary(v: Views) -> DataFrame:
    return rounded(summary_frame(v), "m8_mean")


@query
def summary_positive_stats(v: Views) -> DataFrame:
    return summary.positive_stats(measure_frame(v), ["m4", "m8"], ["m5", "m6"])


@query
def column_variance(v: Views) -> DataFrame:
    return rounded(summary.column_variance(measure_frame(v), ["m4", "m5", "m6", "obese"]), "variance", digits=4)


# products laid out by person
BUCKETS = 8


def stored_days(v: Views) -> DataFrame:
    days = facts(v)
    return layout.stored(days, "person_days", day_buckets(v, days))


def day_buckets(v: Views, days: DataFrame) -> int:
    """Buckets for person-days, which are at most as many as the rows of their sources (counts of the files' footers)."""
    rows = sum(v.table(t).count() for t in ("orders", "lineitem", "events"))
    return layout.bucket_count(v.spark, rows * layout.row_bytes(days), BUCKETS)


@query
def product_person_days(v: Views) -> DataFrame:
    return stored_days(v)


@query
def product_summary(v: Views) -> DataFrame:
    """The summary from two stored tables of equal layout."""
    days = facts(v)
    buckets = day_buckets(v, days)
    cohort = layout.stored(co.build_cohort(v.person(), v.enc(), vw.AS_OF), "cohort", buckets)
    return rounded(summarised(layout.stored(days, "person_days", buckets), cohort), "m8_mean")


@query
def product_lookback(v: Views) -> DataFrame:
    return lookback.recent_rows(stored_days(v))


@query
def product_sequences(v: Views) -> DataFrame:
    days = me.measure_days(v.meas(), v.cohort(), vw.BOUNDS).select("person_id", "day", *STEP_FEATURES)
    buckets = layout.bucket_count(v.spark, v.table("lineitem").count() * layout.row_bytes(days), BUCKETS)
    recent = lookback.recent_rows(layout.stored(days, "measure_days", buckets))
    return seq.flatten_steps(seq.sequences(recent, STEP_FEATURES), STEP_FEATURES)


# top-k
def domains(v: Views) -> dict[str, DataFrame]:
    return {**{d[:3]: v.domain(d) for d in vw.ROUTES}, "mea": v.meas()}


@query
def topk_cells(v: Views) -> DataFrame:
    cells = topk.topk_cells(domains(v), k=10)
    return ind.within_cohort(cells, v.cohort())


@query
def topk_matrix(v: Views) -> DataFrame:
    return topk.topk_matrix(v.cohort(), domains(v), k=100)


@query
def topk_matrix_sparse(v: Views) -> DataFrame:
    """The cells of the sparse vectors: places are turned back into names."""
    vectors = topk.topk_matrix(v.cohort(), domains(v), k=100, sparse=True)
    chosen = topk.chosen_features(topk.stack_domains(domains(v)), list(domains(v)), 100)
    names = F.array(*[F.lit(feature) for _, _, feature in chosen])
    held = F.from_json(F.to_json(F.struct("features")), "features struct<indices:array<int>>")["features"]["indices"]
    return vectors.select("person_id", F.explode(held).alias("place")).select("person_id", names[F.col("place")].alias("feature"))


@query
def topk_page_days(v: Views) -> DataFrame:
    return topk.topk_day_matrix(domains(v), la.outcome(v.labels()), k=20, page=1, lookback=10, sparse=True)


@query
def topk_page_days_dense(v: Views) -> DataFrame:
    return topk.topk_day_matrix(domains(v), la.outcome(v.labels()), k=100, page=0, lookback=10)


@query
def topk_persons_dated(v: Views) -> DataFrame:
    persons = topk.dated_persons(v.cohort(), topk.stack_days({"enc": v.enc(), "occ": v.occ()}))
    return la.attach_outcome(persons, la.outcome(v.labels()))


# lookback
@query
def lookback_rows(v: Views) -> DataFrame:
    return lookback.recent_rows(facts(v))


@query
def lookback_ordered(v: Views) -> DataFrame:
    """In the order of the export: the place of each row counts the rows before it."""
    days = df_.day_facts(v.enc(), [days_of(v, "click"), days_of(v, "view")])
    return lookback.recent_rows(days, ordered=True).select("person_id", "day", "last_day", "first_day", "day_offset")


@query
def lookback_counts(v: Views) -> DataFrame:
    return lookback.recent_counts(lookback.recent_rows(facts(v)))


@query
def lookback_notes(v: Views) -> DataFrame:
    days = df_.day_facts(v.enc(), [days_of(v, "click"), days_of(v, "view")])
    return lookback.join_notes(lookback.recent_rows(days), note_signs(v))


# mentions
def related(v: Views) -> DataFrame:
    return vo.expand_sets(v.mention_members(), v.broad_sets())


def matched(v: Views) -> DataFrame:
    noted = mentions.note_mentions(v.notes(), v.mentions())
    return mentions.match_concepts(mentions.consistent_mentions(noted), related(v), v.small)


def note_signs(v: Views) -> DataFrame:
    return mentions.mention_matrix(matched(v), "set_name", [f"broad-{i}" for i in range(4)], "sympt_")


@query
def indicator_days_salted(v: Views) -> DataFrame:
    """The way beyond the broadcast bound."""
    return ind.indicator_days(v.domain("click"), v.cohort(), resolved_one(v, "click"), vw.INDICATORS, small_fits=False)


@query
def mention_matched_salted(v: Views) -> DataFrame:
    """The way beyond the broadcast bound."""
    noted = mentions.note_mentions(v.notes(), v.mentions())
    return mentions.positive_only(mentions.match_concepts(mentions.consistent_mentions(noted), related(v), False))


@query
def mention_notes(v: Views) -> DataFrame:
    return mentions.note_mentions(v.notes(), v.mentions())


@query
def mention_consistent(v: Views) -> DataFrame:
    return mentions.consistent_mentions(mentions.note_mentions(v.notes(), v.mentions()))


@query
def mention_matched(v: Views) -> DataFrame:
    return mentions.positive_only(matched(v))


def rates(v: Views) -> DataFrame:
    positives = mentions.positive_only(matched(v))
    return mentions.score_concepts(mentions.concept_rates(positives, la.outcome(v.labels()), top=15))


@query
def mention_concept_rates(v: Views) -> DataFrame:
    return rounded(rates(v), "pos", "neg", "max", "score")


@query
def mention_selected(v: Views) -> DataFrame:
    chosen = mentions.select_concepts(rates(v), mentions.positive_only(matched(v)), min_count=100)
    return rounded(chosen, "score")


@query
def mention_pivot(v: Views) -> DataFrame:
    return note_signs(v)


@query
def mention_pivot_names(v: Views) -> DataFrame:
    return mentions.mention_matrix(matched(v), "concept_name", [f"concept, {i}" for i in range(1, 20)])


@query
def mention_pivot_fanout(v: Views) -> DataFrame:
    return mentions.mention_matrix(matched(v), "set_name", [f"broad-{i}" for i in range(4)], "sympt_", fanout=True)


# labels
@query
def outcome_labels(v: Views) -> DataFrame:
    return la.attach_outcome(v.cohort(), la.outcome(v.labels()))


@query
def outcome_setups(v: Views) -> DataFrame:
    each = [la.outcome(v.labels(), s).withColumn("setup", F.lit(s)) for s in la.SETUPS]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query
def split_exact(v: Views) -> DataFrame:
    return la.split_exact(v.cohort(), 0.9, seed=7)


@query
def split_restrict(v: Views) -> DataFrame:
    return la.restrict(v.enc(), la.split_exact(v.cohort(), 0.9, seed=7), "valid")


# sequences
STEP_FEATURES = ["m4", "m5", "m6"]


def recent_measures(v: Views) -> DataFrame:
    return lookback.recent_rows(me.measure_days(v.meas(), v.cohort(), vw.BOUNDS).select("person_id", "day", *STEP_FEATURES))


@query
def seq_build(v: Views) -> DataFrame:
    info = co.min_max_scale(co.build_cohort(v.person(), v.enc(), vw.AS_OF), "age", "age_scaled")
    info = rounded(info.select("person_id", "age_scaled"), "age_scaled")
    arrays = seq.sequences(recent_measures(v), STEP_FEATURES, info, la.outcome(v.labels()))
    return seq.flatten_steps(arrays, STEP_FEATURES, ["age_scaled", "outcome"])


@query
def seq_stats(v: Views) -> DataFrame:
    return seq.feature_stats(recent_measures(v), STEP_FEATURES)


@query
def seq_observed(v: Views) -> DataFrame:
    recent = recent_measures(v).withColumn("never", F.lit(None).cast("double"))
    features = [*STEP_FEATURES, "never"]
    return seq.keep(recent, seq.observed_features(recent, features), features)


@query
def seq_scaled(v: Views) -> DataFrame:
    recent = recent_measures(v)
    stats = seq.feature_stats(recent, STEP_FEATURES)
    out = seq.scale_masked(recent, stats, STEP_FEATURES).select("person_id", "day", *STEP_FEATURES)
    return rounded(out, *STEP_FEATURES)


@query
def seq_padded(v: Views) -> DataFrame:
    padded = seq.pad_sequences(seq.sequences(recent_measures(v), STEP_FEATURES), STEP_FEATURES)
    zipped = padded.select("person_id", F.posexplode(F.arrays_zip("v", "m", "t")).alias("step", "z"))
    cells = [F.col("z.v")[i].alias(f) for i, f in enumerate(STEP_FEATURES)]
    seen = [F.col("z.m")[i].alias(f"{f}_seen") for i, f in enumerate(STEP_FEATURES)]
    return rounded(zipped.select("person_id", "step", F.col("z.t").alias("t"), *cells, *seen), "t")


@query
def seq_batches(v: Views) -> DataFrame:
    arrays = seq.sequences(recent_measures(v), STEP_FEATURES)
    return seq.batch_sequences(arrays, 64, seed=3).select("person_id", F.size("steps").alias("length"), "batch", "batch_length")


@query
def seq_batch_padded(v: Views) -> DataFrame:
    batched = seq.batch_sequences(seq.sequences(recent_measures(v), STEP_FEATURES), 64, seed=3)
    zipped = seq.pad_batches(batched, STEP_FEATURES).select("person_id", "batch", F.posexplode(F.arrays_zip("v", "m", "t")).alias("step", "z"))
    cells = [F.col("z.v")[i].alias(f) for i, f in enumerate(STEP_FEATURES)]
    seen = [F.col("z.m")[i].alias(f"{f}_seen") for i, f in enumerate(STEP_FEATURES)]
    return rounded(zipped.select("person_id", "batch", "step", F.col("z.t").alias("t"), *cells, *seen), "t")


@query
def seq_scaled_fitted(v: Views) -> DataFrame:
    """Statistics of the training persons, saved, read again and applied to the others."""
    recent, split = recent_measures(v), la.split_exact(v.cohort(), 0.9, seed=7)
    path = storage.save_stats(seq.feature_stats(la.restrict(recent, split, "train"), STEP_FEATURES), storage.fresh_path(v.spark, "stats"))
    scaled = seq.scale_masked(la.restrict(recent, split, "valid"), storage.load_stats(v.spark, path), STEP_FEATURES)
    return rounded(scaled.select("person_id", "day", *STEP_FEATURES), *STEP_FEATURES)


@query
def seq_resampled(v: Views) -> DataFrame:
    arrays = seq.sequences(recent_measures(v), STEP_FEATURES)
    return rounded(seq.resample_kernel(arrays, STEP_FEATURES), "time", *STEP_FEATURES, digits=5)


# models
RULE = ("ind3_indicator", "ind5_indicator")


def training(v: Views) -> tuple[DataFrame, list[str]]:
    """The whole summary; the outcome follows a rule of two indicators, so what a model must find is known.

    No feature is the outcome, and no single feature decides it.
    """
    frame = summary_frame(v)
    outcome = F.greatest(*(F.coalesce(F.col(c), F.lit(0)) for c in RULE))
    return frame.withColumn("outcome", outcome), learn.indicator_features(frame.columns)


def fitted(v: Views, kinds: list[str], part: str | None = None):
    frame, features = training(v)
    frame = storage.materialize(frame, "training")
    rows = la.restrict(frame, la.split_exact(v.cohort()), part) if part else frame
    specs = learn.summary_specs(frame.count())
    return learn.fit_models(rows, features, "outcome", {k: specs[k] for k in kinds}), frame, features


def predicted(scores: DataFrame, kind: str) -> DataFrame:
    return scores.select("person_id", ind.flag(F.col(kind) > 0.5).alias("predicted"))


def model_query(kind: str) -> None:
    def run(v: Views) -> DataFrame:
        models, frame, features = fitted(v, [kind])
        return predicted(learn.score(models, frame), kind)

    run.__name__ = f"model_{kind}"
    query(run)


for _kind in ("lr", "lr_balanced", "rf", "gbt"):
    model_query(_kind)


def matrix_query(kind: str) -> None:
    """Models of the sparse concept matrix; the outcome is the most frequent concept of the first domain."""

    def run(v: Views) -> DataFrame:
        cells = storage.materialize(topk.topk_cells(domains(v), k=100), "cells")
        names = [r.feature for r in cells.select("feature").distinct().orderBy("feature").collect()]
        top = topk.rank_concepts(topk.stack_domains({"cli": v.domain("click")}), 1).select("feature")
        rule = cells.join(top, "feature").select("person_id", F.lit(1).alias("outcome"))
        vectors = learn.cell_vectors(v.cohort(), cells, names)
        table = storage.materialize(la.attach_outcome(vectors, rule).withColumn("outcome", F.col("outcome").cast("double")), "matrix")
        models = learn.fit_vectors(table, {kind: learn.matrix_specs(table.count(), len(names))[kind]})
        return predicted(learn.score_vectors(models, table), kind)

    run.__name__ = f"matrix_{kind}"
    query(run)


for _kind in ("lr", "lr_balanced", "rf", "gbt", "mlp"):
    matrix_query(_kind)


@query
def model_roundtrip(v: Views) -> DataFrame:
    """Fit, save, load, align a frame with an extra column, score: the loaded models agree with those in memory."""
    models, frame, features = fitted(v, ["lr", "rf"])
    root = storage.fresh_path(v.spark, "models")
    storage.save_models(models, root)
    storage.save_columns(v.spark, features, f"{root}/columns")
    loaded = storage.load_models(root, list(models))
    columns = storage.load_columns(v.spark, f"{root}/columns")
    aligned = learn.align_columns(frame.withColumn("extra", F.lit(1)), columns)
    ours = learn.score(models, frame).select("person_id", F.struct("lr", "rf").alias("ours"))
    theirs = learn.score(loaded, aligned).select("person_id", F.struct("lr", "rf").alias("theirs"))
    return ours.join(theirs, "person_id", "full").select("person_id", ind.flag(F.col("ours") == F.col("theirs")).alias("same"))


@query
def aligned_columns(v: Views) -> DataFrame:
    """A frame with a missing and an extra column, brought to the training columns."""
    frame, _ = training(v)
    columns = ["ind0_indicator", "ind1_indicator", "ind2_indicator"]
    return learn.align_columns(frame.select("person_id", "ind2_indicator", "ind0_indicator", "age"), columns)


@query
def model_best(v: Views) -> DataFrame:
    """Candidates are fitted on the training part and judged on the validation part."""
    models, frame, features = fitted(v, ["lr", "lr_balanced"], "train")
    split = la.split_exact(v.cohort())
    valid, train = la.restrict(frame, split, "valid"), la.restrict(frame, split, "train")
    name, losses = learn.select_best(models, valid)
    unseen = valid.join(train.select("person_id"), "person_id", "left_semi").count() == 0
    least = losses.agg(F.min("loss").alias("loss")).scalar()
    return losses.select("candidate", F.lit(unseen).alias("unseen"), ((F.col("candidate") != name) | (F.col("loss") == least)).alias("least"))


@query
def feature_ranks(v: Views) -> DataFrame:
    """All ranks of both lists of each model: is the feature one of the rule, is it in both lists, is its weight in order?

    The forest must have the rule's features first. A linear model may share a rule among correlated features, so of
    it only the order counts; that its weights are right is what ``model_gradient`` shows.
    """
    models, frame, features = fitted(v, ["lr", "rf"])
    lists = []
    for name, model in models.items():
        top, least = (learn.feature_ranks(v.spark, model, features, least=b) for b in (False, True))
        both = learn.common_features(top, least).withColumn("in_both", F.lit(True))
        for kind, ranks, sign in (("top", top, -1), ("least", least, 1)):
            before = F.lag(F.col("weight") * sign).over(Window.orderBy("rank"))  # 20 rows
            judged = ranks.withColumn("ordered", F.coalesce(F.col("weight") * sign >= before, F.lit(True)))
            judged = judged.join(both, "feature", "left").withColumn("in_both", F.coalesce("in_both", F.lit(False)))
            rule = F.col("feature").isin(*RULE) if name == "rf" else F.lit(None).cast("boolean")
            lists.append(judged.select(F.lit(name).alias("model"), F.lit(kind).alias("list"), "rank", rule.alias("of_rule"), "in_both", "ordered"))
    return reduce(DataFrame.unionByName, lists)


@query
def model_gradient(v: Views) -> DataFrame:
    """The slope of the penalised loss at the fitted weights, over all persons: 0 for every weight at the optimum.

    The outcome is the recorded one, no feature and no function of them.
    """
    frame, features = training(v)
    frame = la.attach_outcome(frame.drop("outcome"), la.outcome(v.labels()))
    names = sorted(features)
    scaled = frame.select("person_id", "outcome", *[(F.coalesce(F.col(c), F.lit(0)) / (100.0 if c in ("age", "encounters") else 1.0)).alias(c) for c in names])
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(scaled)
    table = storage.materialize(vectors.select("person_id", "features", F.col("outcome").cast("double").alias("outcome")), "gradient")
    rows = table.count()
    specs = {k: learn.summary_specs(rows)[k] for k in ("lr", "lr_balanced")}
    for stages in specs.values():
        stages[-1].setTol(1e-12).setMaxIter(1000)
    found = []
    for kind, model in learn.fit_vectors(table, specs).items():
        weight = learn.WEIGHT if kind == "lr_balanced" else None
        slopes = learn.logistic_gradient(model, learn.balance_weights(table), 1.0 / rows, weight)
        named = F.when(F.col("place") < 0, "intercept").otherwise(F.get(F.array(*map(F.lit, names)), F.col("place")))
        found.append(slopes.select(F.lit(kind).alias("model"), named.alias("weight"), (F.abs("gradient") < 1e-4).alias("flat")))
    return found[0].unionByName(found[1])


@query
def model_grid(v: Views) -> DataFrame:
    """Cross-validation of three penalties on the recorded outcome: each candidate on each fold, and the winner."""
    frame, features = training(v)
    names = sorted(features)
    filled = la.attach_outcome(frame.drop("outcome"), la.outcome(v.labels())).fillna(0, subset=names)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(filled)
    table = storage.materialize(vectors.select("person_id", "features", F.col("outcome").cast("double").alias("outcome")), "grid-input")
    specs = {f"c{c}": [LogisticRegression(labelCol="outcome", regParam=10.0**-c, maxIter=50)] for c in (0, 2, 4)}
    best, model, losses = learn.grid_search(table, specs, folds=3, seed=5)
    ranks = learn.grid_ranks(losses)
    refitted = model.stages[-1].getOrDefault("regParam") == specs[best][0].getOrDefault("regParam")
    least = ranks.agg(F.min("loss").alias("loss")).scalar()
    judged = losses.join(ranks.select("candidate", F.col("loss").alias("mean")), "candidate")
    won = (F.col("candidate") == best) & F.lit(refitted)
    return judged.select("candidate", "fold", "rows", (~won | (F.col("mean") == least)).alias("winner_is_least"))


def vectors_of(frame: DataFrame, names: list[str]) -> DataFrame:
    """(person_id, features, outcome), written once for the rounds that read it and dealt by its values."""
    filled = frame.select("person_id", "outcome", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    table = VectorAssembler(inputCols=names, outputCol="features").transform(filled)
    return learn.spread_vectors(storage.materialize(table.select("person_id", "features", F.col("outcome").cast("double").alias("outcome")), "vectors"))


@query
def model_gbt_exponential(v: Views) -> DataFrame:
    """Boosting by exponential loss on subsamples of rows and features finds the rule of two indicators."""
    frame, features = training(v)
    table = vectors_of(frame, sorted(features))
    model = boosting.fit_exponential(table, rounds=20, depth=4, step=0.3, subset="onethird")
    return predicted(learn.score_vectors({"gbt_exponential": model}, table), "gbt_exponential")


@query
def boost_rounds(v: Views) -> DataFrame:
    """The mean row weight of every round, over all persons, for the recorded outcome and two features.

    Trees of depth 2 tell all four values of two indicators apart, so every round has a closed form.
    """
    frame, _ = training(v)
    table = vectors_of(la.attach_outcome(frame.drop("outcome"), la.outcome(v.labels())), list(RULE))
    model = boosting.fit_exponential(table, rounds=8, depth=2, step=0.25, share=1.0, subset="all")
    return rounded(boosting.round_losses(model, table), "loss")


@query
def ensemble_scores(v: Views) -> DataFrame:
    orders = v.table("orders").groupBy(F.col("o_custkey").alias("person_id")).agg(
        (F.count(F.lit(1)) % 10 / 10.0).alias("score_a"), (F.max("o_orderkey") % 100 / 100.0).alias("score_b")
    )
    users = v.occ().groupBy("person_id").agg((F.max("concept_id") / 100.0).alias("score_c"))
    out = learn.ensemble(v.cohort(), [orders, users], {"score_c": 0.5})
    return rounded(out, "probability")


# metrics
def scored(v: Views) -> DataFrame:
    return v.table("lineitem").select(
        ind.flag(F.col("l_returnflag") == "R").alias("label"),
        (F.col("l_discount") * 10).alias("score"),
        (F.col("l_tax") * 10).alias("other"),
        ind.flag(F.col("l_linestatus") == "F").alias("mask"),
    )


@query
def binary_metrics(v: Views) -> DataFrame:
    out = metrics.binary_metrics(scored(v), "label", "score")
    return rounded(out, "log_loss", "accuracy", "recall", "precision", "auc")


@query
def roc_by_group(v: Views) -> DataFrame:
    """Areas per status and in groups that may have one class."""
    rows = v.table("lineitem").select(
        "l_linestatus",
        F.when(F.col("l_linenumber") > 5, "late").alias("part"),
        ind.flag((F.col("l_returnflag") == "R") & (F.col("l_linenumber") != 7)).alias("label"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 10_000 - 3).alias("score"),
    )
    return rounded(metrics.area_under_roc(rows, "label", "score", ["l_linestatus", "part"]), "auc")


@query
def grid_losses(v: Views) -> DataFrame:
    """Cross-entropy of two scores on every fold, and the rank of each by its mean."""
    folded = v.table("lineitem").select(
        ind.flag(F.col("l_returnflag") == "R").alias("label"),
        (F.col("l_discount") * 10).alias("discount"),
        (F.col("l_tax") * 10).alias("tax"),
        learn.fold_of("l_orderkey", 3, seed=5).alias("fold"),
    )
    losses = learn.grid_losses(folded, "label", {"discount": "discount", "tax": "tax"})
    ranks = learn.grid_ranks(losses).select("candidate", F.col("loss").alias("mean"), "rank")
    return rounded(losses.join(ranks, "candidate"), "loss", "mean")


@query
def class_report(v: Views) -> DataFrame:
    return rounded(metrics.class_report(scored(v), "label", "score"), "precision", "recall", "f1")


@query
def candidate_losses(v: Views) -> DataFrame:
    return rounded(metrics.candidate_losses(scored(v), "label", {"discount": "score", "tax": "other"}), "loss")


@query
def masked_mse(v: Views) -> DataFrame:
    return rounded(metrics.masked_mse(scored(v), "score", "other", "mask"), "mse")
