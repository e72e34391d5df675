"""Weight rules: checks of incoming changes and audits of stored data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradebook.functions.scores import ASSESSMENT_WEIGHT_CAP, FINAL_EXAM_WEIGHT, TOTAL_WEIGHT_CAP
from gradebook.operators.aggregates import weights_per_course
from gradebook.operators.graphs import components
from gradebook.operators.keyed import top_per_key
from gradebook.operators.positions import running_total_within
from gradebook.sources.checkpoints import checkpointed
from gradebook.sources.tables import Gradebook

# Messages of the rules.
NOT_FOUND = "Assessment not found."
WEIGHT_EXCEEDED = "Total assessment weight exceeds 70%."
COMBINED_EXCEEDED = "Combined weight exceeds 100%%. Current assessments weight: %s%%."


def check_weights(
    assessments: DataFrame, changes: DataFrame, cap: int = ASSESSMENT_WEIGHT_CAP
) -> DataFrame:
    """Add ``accepted`` and ``reason`` to assessment inserts (no id) and edits (id).

    The batch counts as if its changes arrived one by one in ``seq`` order, which must be unique: a
    change is accepted if the other weights of its course and its own stay within
    ``cap``, and only then counts for later ones. Edits replace the weight the id has by then and may move it to
    another course. A NULL weight counts as 0. Unknown ids are rejected. Nothing is
    assumed of stored weights.

    Courses between which the batch may move an assessment form a cluster; without
    moves each is one of its own. A cluster's changes are walked in order in one pass that holds
    only the weights of its courses and edited ids. Inserts do not all take part: see ``_pruned``.
    """
    keep = changes.columns
    stored = assessments.select("id", F.col("course_id").alias("_home"), F.coalesce("weight", F.lit(0)).cast("bigint").alias("_old"))
    rows = changes.select("seq", "id", "course_id", F.coalesce("weight", F.lit(0)).cast("bigint").alias("weight"))
    edits = checkpointed(rows.where("id IS NOT NULL").join(stored, "id"))
    base = assessments.groupBy("course_id").agg(F.sum("weight").cast("bigint").alias("base"))
    moves = edits.where("_home <> course_id").select(F.col("_home").alias("u"), F.col("course_id").alias("v")).distinct()
    roots = components(moves).select(F.col("node").alias("course_id"), F.col("root").alias("cluster"))

    inserts, alike = _pruned(rows.where("id IS NULL"), edits, base, cap)
    walked = edits.unionByName(inserts, allowMissingColumns=True)
    touched = walked.select("course_id").unionByName(edits.select(F.col("_home").alias("course_id"))).distinct()
    begin = touched.join(base, "course_id", "left").select("course_id", F.coalesce("base", F.lit(0)).alias("weight"))
    queue = (
        begin.withColumn("turn", F.lit(0)).unionByName(walked.withColumn("turn", F.lit(1)), allowMissingColumns=True)
        .join(roots, "course_id", "left").withColumn("cluster", F.coalesce("cluster", "course_id")))
    verdicts = _walked(queue, cap)
    verdicts = checkpointed(verdicts)
    zero = alike.where("first").join(verdicts, "seq").select("course_id", "stretch", "accepted")
    verdicts = verdicts.unionByName(
        alike.where("NOT first").join(zero, ["course_id", "stretch"]).select("seq", "accepted"))
    known = edits.select("seq", F.lit(True).alias("_known"))
    return (
        changes.join(verdicts.withColumnRenamed("accepted", "_accepted"), "seq", "left").join(known, "seq", "left")
        .select(
            *keep, F.coalesce("_accepted", F.lit(False)).alias("accepted"),
            F.when(F.col("id").isNotNull() & F.col("_known").isNull(), NOT_FOUND)
            .when(F.coalesce("_accepted", F.lit(False)), None).otherwise(WEIGHT_EXCEEDED).alias("reason")))


def _pruned(inserts: DataFrame, edits: DataFrame, base: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The inserts that can be accepted, and those of weight 0 by the stretch in which they share one verdict.

    A course can only gain room at an insert of negative weight and at an edit of an id that may be in it:
    one stored in it, or sent to it by the batch. Between two such places its room only
    shrinks, so of the inserts of one weight the accepted come before the rejected, and no more than
    room / weight fit; the first that many decide, the rest are rejected for certain. The room is taken from the least
    weight the course can have in the whole batch. So the number of inserts walked depends on the cap and on the edits, not on
    how many inserts a course receives.
    """
    homes = edits.select("id", F.col("_home").alias("course_id")).unionByName(edits.select("id", "course_id")).distinct()
    greatest = edits.groupBy("id").agg(F.max(F.greatest("weight", "_old")).alias("most"), F.min(F.least("weight", F.lit(0))).alias("least"))
    freed = homes.join(greatest, "id").groupBy("course_id").agg(F.sum(F.greatest(F.lit(0), F.col("most")) - F.col("least")).alias("freed"))
    negative = inserts.where("weight < 0")
    lower = freed.unionByName(negative.groupBy("course_id").agg((-F.sum("weight")).alias("freed"))).groupBy("course_id").agg(F.sum("freed").alias("freed"))
    events = (
        homes.join(edits.select("id", "seq"), "id").select("course_id", "seq").distinct()
        .unionByName(negative.select("course_id", "seq")).withColumn("event", F.lit(1)))
    positive = inserts.where("weight >= 0")
    placed = running_total_within(
        positive.withColumn("event", F.lit(0)).unionByName(events, allowMissingColumns=True), "course_id", [F.col("seq"), F.col("event")],
        F.col("event"), "stretch").where("event = 0").drop("event")
    room = F.lit(cap) - F.coalesce("base", F.lit(0)) + F.coalesce("freed", F.lit(0))
    roomy = placed.join(base, "course_id", "left").join(lower, "course_id", "left").withColumn("room", room)
    zero = roomy.where("weight = 0")
    firsts = zero.groupBy("course_id", "stretch").agg(F.min("seq").alias("seq")).withColumn("first", F.lit(True))
    alike = checkpointed(
        zero.select("course_id", "stretch", "seq").join(firsts, ["course_id", "stretch", "seq"], "left")
        .withColumn("first", F.coalesce("first", F.lit(False))))
    fitting = roomy.where("weight > 0 AND weight <= room").withColumn("fits", F.floor(F.col("room") / F.col("weight")))
    most = fitting.agg(F.max("fits").alias("n")).first().n
    taken = (
        top_per_key(fitting, ["course_id", "stretch", "weight"], [F.asc("seq")], most).where("position <= fits")
        if most else fitting)
    columns = ["seq", "course_id", "weight"]
    return (
        taken.select(*columns).unionByName(negative.select(*columns))
        .unionByName(alike.where("first").select("seq", "course_id", F.lit(0).cast("bigint").alias("weight")))
        .withColumn("id", F.lit(None).cast("bigint")), alike)


def _walked(queue: DataFrame, cap: int) -> DataFrame:
    """(seq, accepted) of a one-by-one walk through each cluster, as a stream: only current weights are held."""

    def walk(batches):
        import pyarrow as pa

        cluster, weights, ids = None, {}, {}
        for batch in batches:
            seqs, verdicts = [], []
            columns = [batch.column(c).to_pylist() for c in ("cluster", "turn", "seq", "course_id", "weight", "id", "_home", "_old")]
            for at, turn, seq, course, weight, id_, home, old in zip(*columns):
                if at != cluster:
                    cluster, weights, ids = at, {}, {}
                if turn == 0:
                    weights[course] = weight
                    continue
                if id_ is not None:
                    home, old = ids.get(id_, (home, old))
                others = weights[course] - (old if id_ is not None and home == course else 0)
                fits = others + weight <= cap
                if fits:
                    if id_ is not None:
                        weights[home] -= old
                        ids[id_] = (course, weight)
                    weights[course] += weight
                seqs.append(seq)
                verdicts.append(fits)
            yield pa.record_batch([pa.array(seqs, pa.int64()), pa.array(verdicts, pa.bool_())], names=["seq", "accepted"])

    ordered = queue.select("cluster", "turn", "seq", "course_id", "weight", "id", "_home", "_old")
    return (
        ordered.repartition("cluster").sortWithinPartitions("cluster", "turn", "seq")
        .mapInArrow(walk, "seq bigint, accepted boolean"))


def check_final_weight(
    db: Gradebook, changes: DataFrame, cap: int = TOTAL_WEIGHT_CAP
) -> DataFrame:
    """Add ``accepted`` and ``reason`` to final-mark changes: course weight plus exam weight within ``cap``."""
    weights = db.dim("assessments", db.assessments.groupBy("course_id").agg(F.sum("weight").alias("_weight")))
    weight = F.coalesce("_weight", F.lit(0))
    exam = F.coalesce("final_exam_weight", F.lit(float(FINAL_EXAM_WEIGHT)))
    accepted = weight + exam <= cap
    message = F.format_string(COMBINED_EXCEEDED, weight.cast("string"))
    return changes.join(weights, "course_id", "left").select(
        *changes.columns, accepted.alias("accepted"), F.when(~accepted, message).alias("reason"))


def weight_violations(
    db: Gradebook, cap: int = ASSESSMENT_WEIGHT_CAP, final_weight: int = FINAL_EXAM_WEIGHT,
    total_cap: int = TOTAL_WEIGHT_CAP,
) -> DataFrame:
    """Courses whose stored weights already break a rule."""
    total = F.col("total_weight")
    return weights_per_course(db).select(
        "course_id", "total_weight", (total > cap).alias("over_cap"),
        (total + final_weight > total_cap).alias("over_total")).where("over_cap OR over_total")
