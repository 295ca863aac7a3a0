"""Relational operators: upserts, ranking per group, resuming, and checks on keys.

Tables are DataFrames; an upsert returns the new table and leaves it to the caller where to write it (see
sources.tables.swap). All of them shuffle on the key once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1; the planner cuts groups before it shuffles them."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def upsert_last_wins(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of all rows of a key the one with the greatest `order`, on ties the new table's."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    values = [c for c in old.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(order, "_new")).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in old.columns])


def upsert_greatest(old: DataFrame, new: DataFrame, keys: Sequence[str], score: str, latest: str) -> DataFrame:
    """One row per key: the greatest score of any row, and `latest` of the new table where it has the key."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return rows.groupBy(*keys).agg(F.max(score).alias(score), F.max_by(latest, F.struct("_new", latest)).alias(latest))


def insert_do_nothing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`old` and those rows of `new` whose key it lacks; of several such rows with one key the smallest, column by column."""
    values = [c for c in old.columns if c not in keys]
    fresh = new.join(old.select(*keys), list(keys), "left_anti").groupBy(*keys).agg(F.min(F.struct(*values)).alias("_row"))
    return old.unionByName(fresh.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values]))


def update_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """`old` with `columns` as `new` has them, null included, where it has the key, which is unique there; and rows for keys that are only
    in `new`, their other columns null."""
    marked = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_set"))
    rows = old.join(marked, list(keys), "full")
    return rows.select(*[F.when(F.col("_set"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def without(rows: DataFrame, column: str, value: object) -> DataFrame:
    """What is left when all rows of one value, such as a model's, are deleted; rows without a value stay."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(value)))


def key_map(rows: DataFrame, targets: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """rows with the id of the target that has their natural key, null for those without: a bulk load's look-up. Of
    several targets with one key the smallest id counts."""
    ids = targets.groupBy(*keys).agg(F.min(id_column).alias(id_column))
    return rows.join(ids, list(keys), "left")


def coverage(children: DataFrame, parents: DataFrame, by: str, parent_column: str, parent_id: str) -> DataFrame:
    """(by, n, n_parents, n_all, percent) per value of `by`, such as a model: children, parents that have any, all parents."""
    total = parents.agg(F.count_distinct(parent_id).alias("n_all"))  # one row
    known = children.join(parents.select(F.col(parent_id).alias(parent_column)).distinct(), parent_column, "left_semi")
    rows = known.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(parent_column).alias("n_parents"))
    return rows.crossJoin(total).withColumn("percent", F.round(100 * F.col("n_parents") / F.col("n_all"), 6))


def eligible_and_missing(parents: DataFrame, children: DataFrame, parent_id: str, child_key: str, by: str) -> DataFrame:
    """(by, n_eligible, n_missing): parents, and those among them without any child yet."""
    done = children.select(F.col(child_key).alias(parent_id), F.lit(True).alias("_has")).distinct()
    return parents.join(done, parent_id, "left").groupBy(by).agg(F.count("*").alias("n_eligible"), F.count_if(F.col("_has").isNull()).alias("n_missing"))


def replace_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the keys that `new` has are replaced by its rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def missing_from(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is left to do: rows of `work` whose key isn't among those done."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows that a cascade would delete: their parent is gone."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def alias_view(documents: DataFrame, aliases: DataFrame, id_column: str, alias_column: str, document_column: str) -> DataFrame:
    """Documents under their own ids and under their aliases: (lookup_id, id, is_alias)."""
    own = documents.select(F.col(id_column).alias("lookup_id"), F.col(id_column).alias("id"), F.lit(False).alias("is_alias"))
    others = aliases.select(F.col(alias_column).alias("lookup_id"), F.col(document_column).alias("id")).join(documents.select(F.col(id_column).alias("id")), "id", "left_semi")
    return own.unionByName(others.select("lookup_id", "id", F.lit(True).alias("is_alias")))


def alias_collisions(documents: DataFrame, aliases: DataFrame, id_column: str, alias_column: str, document_column: str) -> DataFrame:
    """Aliases that are the id of another document; must be none before aliases are appended."""
    d = documents.select(F.col(id_column).alias("_other"))
    return aliases.join(d, (F.col(alias_column) == F.col("_other")) & (F.col(document_column) != F.col("_other")), "left_semi")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, nulls counted as values: what a unique constraint should have refused."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def session_list(messages: DataFrame, session: str, seq: str, role: str, content: str, k: int = 40) -> DataFrame:
    """The k sessions with the most user turns: turns, user turns, the first user message. Sessions without any are left out."""
    user = F.col(role) == "user"
    out = messages.groupBy(session).agg(
        F.count("*").alias("n_turns"),
        F.count_if(user).alias("n_user"),
        F.min_by(F.when(user, F.col(content)), F.when(user, F.col(seq))).alias("first_message"),
        F.max(seq).alias("last_turn"),
    )
    return out.where("n_user > 0").orderBy(F.desc("n_user"), session).limit(k)


def last_turns(messages: DataFrame, session: str, seq: str, k: int = 8) -> DataFrame:
    """The last k turns of each session, oldest first by `seq`."""
    return top_per_group(messages, [session], [F.desc(seq)], k, "_back").drop("_back")


def round_robin(rows: DataFrame, session: str, turn: str, item: str, score: str, k: int = 5, most: int | None = None) -> DataFrame:
    """k items per session, one from each turn in turn, each turn's best first: rank by depth within the turn, then
    turn. `most` applies a cut by score, then later turns first, before that, which can starve turns; by default there is none."""
    if most is not None:
        rows = top_per_group(rows, [session], [F.desc(score), F.desc(turn), F.asc(item)], most, "_cut").drop("_cut")
    depth = F.row_number().over(Window.partitionBy(session, turn).orderBy(F.desc(score), F.asc(item)))
    return top_per_group(rows.withColumn("depth", depth), [session], [F.asc("depth"), F.asc(turn)], k)


def append_turns(messages: DataFrame, new: DataFrame, session: str, seq: str) -> DataFrame:
    """The two rows that a turn adds to each session of `new` (session, user, assistant), which are unique there: the user's message and the answer, after the
    session's last row in `messages`, from 0 if it has none."""
    last = messages.groupBy(session).agg(F.max(seq).alias("_last"))
    begins = new.join(last, session, "left").withColumn("_next", F.coalesce(F.col("_last") + 1, F.lit(0)))
    row = lambda i, role: F.struct((F.col("_next") + i).alias(seq), F.lit(role).alias("role"), F.col(role).alias("text"))
    return begins.select(session, F.inline(F.array(row(0, "user"), row(1, "assistant"))))


def worklist(known: DataFrame, key: str, checked: str, before: Column) -> DataFrame:
    """What is to be fetched: keys never checked, or not since `before`, in the order of keys."""
    return known.where(F.col(checked).isNull() | (F.col(checked) < before)).select(key).orderBy(key)


def crawl_round(known: DataFrame, fetched: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """known (key, hash, checked) after a round of fetched (key, hash, checked, error), and the rows to append to the log. A page that failed keeps its hash but
    has been checked; one that is new is added; the log has a row for each change and each failure."""
    found = fetched.select(key, F.col("hash").alias("_hash"), F.col("checked").alias("_checked"), "error")
    met = known.join(found, key, "full")
    got = F.col("_checked").isNotNull() & F.col("error").isNull()
    after = met.select(key, F.when(got, F.col("_hash")).otherwise(F.col("hash")).alias("hash"), F.coalesce("_checked", "checked").alias("checked"))
    kind = F.when(F.col("error").isNotNull(), "failed").when(F.col("hash").isNull(), "added").when(F.col("hash") != F.col("_hash"), "changed")
    log = met.where(F.col("_checked").isNotNull()).select(key, F.col("_checked").alias("checked"), kind.alias("kind"), "error").where("kind IS NOT NULL")
    return after, log
