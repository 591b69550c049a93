"""Entity resolution: name normalisation, pair scores, automatic merges and a review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators.graph import cut

#: Titles before a name, suffixes after it, thresholds.
TITLES = "mr|mrs|ms|miss|dr|prof|sir|judge|hon|rev|sen|rep|gov|gen|col|capt|lt|sgt"
SUFFIXES = "jr|sr|ii|iii|iv|esq|phd|md"
EXACT, INITIAL, DROP, SAME_TYPE, TOGETHER, AUTO = 0.95, 0.70, 0.60, 0.10, 0.10, 0.85


def normalized(name: Column) -> Column:
    """Lower case without one title and one suffix, 'Last, First' turned round, no punctuation, single spaces."""
    x = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    x = F.regexp_replace(x, rf"^(?:{TITLES})\.?\s+", "")
    x = F.regexp_replace(x, rf",?\s+(?:{SUFFIXES})\.?$", "")
    x = F.regexp_replace(x, r"^([^,]+),\s*(.+)$", "$2 $1")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w\s]", ""), r"\s+", " "))


def _words(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; 0 if either side is empty."""
    x, y = F.array_distinct(_words(a)), F.array_distinct(_words(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def initial_match(a: Column, b: Column) -> Column:
    """Same last word, and one of the first words is a single letter that begins the other."""
    x, y = _words(a), _words(b)
    p, q = F.try_element_at(x, F.lit(1)), F.try_element_at(y, F.lit(1))
    single = ((F.length(p) == 1) & F.startswith(q, p)) | ((F.length(q) == 1) & F.startswith(p, q))
    return F.coalesce((F.size(x) >= 2) & (F.size(y) >= 2) & (F.try_element_at(x, F.lit(-1)) == F.try_element_at(y, F.lit(-1))) & single, F.lit(False))


def edit_score(a: Column, b: Column) -> Column:
    """0.80 less 0.10 for each edit, for names over eight letters at most two edits apart; else null."""
    d = F.levenshtein(a, b, 2)
    return F.when((F.length(a) > 8) & (F.length(b) > 8) & (d >= 0), F.lit(0.80) - 0.10 * d)


def _named(entities: DataFrame) -> DataFrame:
    return entities.select("id", "type", normalized(F.col("name")).alias("n")).filter("n <> ''")


def classes(entities: DataFrame) -> DataFrame:
    """(class_id, type, n, size, last): entities of one type whose names are equal once normalised; a class has the number of its first entity."""
    return _named(entities).groupBy("type", "n").agg(F.min("id").alias("class_id"), F.count("*").alias("size"), F.max("id").alias("last")).select("class_id", "type", "n", "size", "last")


def membership(entities: DataFrame) -> DataFrame:
    """(entity_id, class_id) of every entity that has a name."""
    return _named(entities).join(classes(entities).select("type", "n", "class_id"), ["type", "n"]).select(F.col("id").alias("entity_id"), "class_id")


#: Length up to which names meet under what is left of them without two letters.
WHOLE = 24


def _parts(names: DataFrame) -> DataFrame:
    """(type, n, kind, part): words of names, and runs of five letters of those longer than ``WHOLE`` (twenty-one or more, of which two edits change at most ten)."""
    one = names.select("type", "n", F.array_distinct(_words(F.col("n"))).alias("parts"), F.lit("w").alias("kind"))
    grams = names.filter(F.length("n") > WHOLE).select("type", "n", F.expr("array_distinct(transform(sequence(1, length(n) - 4), k -> substr(n, k, 5)))").alias("parts"), F.lit("g").alias("kind"))
    return one.unionAll(grams).select("type", "n", "kind", F.explode("parts").alias("part"))


def _keys(parts: DataFrame, common: DataFrame) -> DataFrame:
    """(type, n, key): the parts of a name under which it is filed, its rarest by ``common`` (type, kind, part, f); what that does not hold is rarest."""
    placed = parts.join(common, ["type", "kind", "part"], "left").withColumn("f", F.coalesce("f", F.lit(0)))
    rarest = placed.groupBy("type", "n", "kind").agg(F.array_sort(F.collect_list(F.struct("f", "part"))).alias("p"))
    return rarest.select("type", "n", F.explode(F.expr("slice(p, 1, IF(kind = 'g', 11, size(p) - size(p) div 2))")).alias("x"), "kind").select("type", "n", F.xxhash64("kind", "x.part").alias("key"))


def _shortened(names: DataFrame) -> DataFrame:
    """(type, n, key): names of nine letters to ``WHOLE`` and two more, under a hash of each string that is left without none, one or two of their letters.

    Names at most two edits apart share one of these, and others hardly ever, whatever stretches are common to many names.
    """
    some = names.filter(f"length(n) BETWEEN 9 AND {WHOLE + 2}")
    less = "concat(substr(n, 1, i - 1), substr(n, i + 1, j - i - 1), substr(n, j + 1))"  # without the letters i < j; j past the end takes one, both none
    keys = f"array_distinct(flatten(transform(sequence(1, length(n) + 1), i -> transform(sequence(i + 1, length(n) + 2), j -> xxhash64('d', {less})))))"
    return some.select("type", "n", F.explode(F.expr(keys)).alias("key"))


def _ends(names: DataFrame) -> DataFrame:
    """(type, n, initial, last, short) of names of two words or more; ``short``: the first is a single letter."""
    words = _words(F.col("n"))
    first = F.try_element_at(words, F.lit(1))
    return names.filter(F.size(words) >= 2).select("type", "n", F.substring(first, 1, 1).alias("initial"), F.try_element_at(words, F.lit(-1)).alias("last"), (F.length(first) == 1).alias("short"))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """(type, na, nb) of different names that share a key and are alike enough by words or edits; what is not goes no further.

    Names have a hundred keys and look small before these are written out, so neither side may be sent whole to all tasks.
    """
    both = left.select("type", F.col("n").alias("na"), "key").join(right.select("type", F.col("n").alias("nb"), "key").hint("merge"), ["type", "key"])
    return both.filter("na <> nb").filter(_soft() >= DROP).select("type", "na", "nb")


def _begun(left: DataFrame, right: DataFrame) -> DataFrame:
    """(type, na, nb) of different names that end alike and begin with one letter, which is the whole first word of one of them."""
    both = left.select("type", F.col("n").alias("na"), "initial", "last", F.col("short").alias("sa")).join(right.select("type", F.col("n").alias("nb"), "initial", "last", F.col("short").alias("sb")), ["type", "initial", "last"])
    return both.filter("na <> nb AND (sa OR sb)").select("type", "na", "nb")


def _soft() -> Column:
    j = jaccard(F.col("na"), F.col("nb"))
    return F.greatest(F.when(j > 0.5, j).otherwise(0.0), F.coalesce(edit_score(F.col("na"), F.col("nb")), F.lit(0.0)))


def _close(pairs: DataFrame) -> DataFrame:
    """(type, na, nb, base), na < nb, of pairs of names that are alike enough."""
    once = pairs.select("type", F.least("na", "nb").alias("na"), F.greatest("na", "nb").alias("nb")).distinct()
    soft = _soft()
    base = F.when(initial_match(F.col("na"), F.col("nb")), F.greatest(F.lit(INITIAL), soft)).otherwise(soft)
    return once.withColumn("base", base).filter(F.col("base") >= DROP)


def _close_names(names: DataFrame) -> DataFrame:
    """Names meet over their rarest parts only (prefix filter), so a common word makes no large block: of words that are half
    shared, one is among the rarest of either name; of two names at most two edits apart, both are the same without some two
    letters, or of long ones one run of five letters is among the eleven rarest of either; an initial meets the names that
    start with it and end alike."""
    parts = _parts(names)
    keys, ends = _keys(parts, parts.groupBy("type", "kind", "part").agg(F.count("*").alias("f"))), _ends(names)
    keys = keys.unionAll(_shortened(names))
    return _close(_met(keys, keys).filter("na < nb").unionAll(_begun(ends.filter("short"), ends)))


def class_links(entities: DataFrame) -> DataFrame:
    """(a, b, base), a < b: classes whose names are alike enough.  Output follows the names, however many entities share one."""
    c = classes(entities).select("type", "n", "class_id")
    near = _close_names(c.select("type", "n"))
    both = near.join(c.toDF("type", "na", "x"), ["type", "na"]).join(c.toDF("type", "nb", "y"), ["type", "nb"])
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "base")


def _together(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """The pairs (a, b) of entities that one document holds, looked up from the end that is in fewer documents."""
    m = mentions.select("document_id", "entity_id").distinct()
    n = m.groupBy("entity_id").agg(F.count("*").alias("n"))
    sized = pairs.select("a", "b").distinct().join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    ends = sized.select("a", "b", F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("few"), F.when(F.col("na") <= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("many"))
    held = ends.join(m.toDF("document_id", "few"), "few").join(m.toDF("document_id", "many"), ["document_id", "many"])
    return held.select("a", "b").distinct()


def _scored(found: DataFrame, mentions: DataFrame) -> DataFrame:
    """(source, target, confidence, action) of pairs (a, b, base) of entities."""
    near = _together(found, mentions).withColumn("together", F.lit(TOGETHER))
    out = found.join(near, ["a", "b"], "left").select(F.col("a").alias("source"), F.col("b").alias("target"), _total(F.coalesce("together", F.lit(0.0))).alias("confidence"))
    return _decided(out)


def _total(together: Column) -> Column:
    return F.least(F.lit(1.0), F.col("base") + SAME_TYPE + together)


def _decided(scored: DataFrame) -> DataFrame:
    return scored.withColumn("action", F.when(F.col("confidence") >= AUTO, "auto").otherwise("queue"))


def candidates(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(source, target, confidence, action) for every pair of entities of one type, source < target, above the thresholds.

    This is ``class_links`` and the pairs inside of classes, written out by entity: n entities of one name have n (n - 1) / 2 of
    them.  ``mapping`` does without.
    """
    e = _named(entities)
    names = e.select("type", "n").distinct()
    matches = _close_names(names).unionAll(names.select("type", F.col("n").alias("na"), F.col("n").alias("nb"), F.lit(EXACT).alias("base")))
    ends, others = e.toDF("x", "type", "na"), e.toDF("y", "type", "nb")
    once = "x < y OR (x > y AND na <> nb)"
    # who stands in a document with x under a name that matches: pairs are written out last, and nothing of them travels
    m = mentions.select("document_id", "entity_id").distinct()
    held = m.withColumnRenamed("entity_id", "x").join(ends, "x").join(matches, ["type", "na"]).select("document_id", "x", "type", "na", "nb")
    met = held.join(m.withColumnRenamed("entity_id", "y").join(others, "y"), ["document_id", "type", "nb"]).filter(once)
    partners = met.groupBy("x").agg(F.collect_set("y").alias("partners"))
    both = matches.join(ends.join(partners, "x", "left"), ["type", "na"]).join(others, ["type", "nb"]).filter(once)
    together = F.when(F.array_contains("partners", F.col("y")), TOGETHER).otherwise(0.0)
    return _decided(both.select(F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target"), _total(together).alias("confidence")))


def mapping(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """``resolved(candidates(...))`` from classes: (source_entity_id, canonical_entity_id).

    A class merges into its last entity, and into that of a class whose name alone is sure enough.  Only entities of the other
    linked classes are looked up in documents, where standing together would make them sure.
    """
    c, members = classes(entities), membership(entities)
    links = class_links(entities)
    ends = links.select(F.col("a").alias("class_id"), F.col("b").alias("other"), "base").unionAll(links.select(F.col("b").alias("class_id"), F.col("a").alias("other"), "base"))
    last = c.select(F.col("class_id").alias("other"), "last")
    sure = ends.filter(F.col("base") + SAME_TYPE >= AUTO).select("class_id", "other").unionAll(c.select("class_id", F.col("class_id").alias("other")))
    by_class = sure.join(last, "other").groupBy("class_id").agg(F.max("last").alias("target"))
    plain = members.join(by_class, "class_id").select(F.col("entity_id").alias("source"), "target")
    weak = ends.filter((F.col("base") + SAME_TYPE < AUTO) & (F.col("base") + SAME_TYPE + TOGETHER >= AUTO)).select("class_id", "other")
    m = mentions.select("document_id", "entity_id").distinct().join(members, "entity_id")
    one = m.join(weak, "class_id").select("document_id", F.col("entity_id").alias("source"), "other")
    both = one.join(m.select("document_id", F.col("entity_id").alias("target"), F.col("class_id").alias("other")), ["document_id", "other"])
    every = plain.unionAll(both.select("source", "target")).filter("target > source")
    return every.groupBy(F.col("source").alias("source_entity_id")).agg(F.max("target").alias("canonical_entity_id"))


class NameIndex:
    """The names of entities filed under their keys, so that one name or a batch of them finds what it may be without a look at the others.

    How rare a part is stays as it was when the index was written: names that come later are filed by the same order, so the
    prefix filter misses none.  Adding the same entities twice changes nothing.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def write(cls, entities: DataFrame, folder: str) -> NameIndex:
        own = cls(entities.sparkSession, folder)
        parts = _parts(_named(entities).select("type", "n").distinct())
        own._put("common", parts.groupBy("type", "kind", "part").agg(F.count("*").alias("f")), "part", "overwrite")
        own._file(entities, "overwrite")
        return own

    def add(self, entities: DataFrame) -> None:
        self._file(entities, "append")

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.BUCKETS)).cast("int")

    def _put(self, table: str, rows: DataFrame, by: str, mode: str) -> None:
        rows.withColumn("bucket", self._bucket(by)).repartition("bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(4))).sortWithinPartitions("bucket", by).write.mode(mode).partitionBy("bucket").parquet(f"{self.folder}/{table}")

    def _get(self, table: str, schema: str, wanted: DataFrame, by: str) -> DataFrame:
        """Rows of a table in the buckets of wanted values; at most ``BUCKETS`` numbers are collected."""
        buckets = [r.b for r in wanted.select(self._bucket(by).alias("b")).distinct().collect()]
        rows = self.spark.read.schema(schema + ", bucket int").parquet(f"{self.folder}/{table}").filter(F.col("bucket").isin(buckets)).drop("bucket")
        return rows.join(wanted.select(by).distinct(), by, "left_semi").distinct()

    def _keys_of(self, names: DataFrame) -> DataFrame:
        parts = _parts(names)
        return _keys(parts, self._get("common", "type string, kind string, part string, f long", parts, "part")).unionAll(_shortened(names))

    def _file(self, entities: DataFrame, mode: str) -> None:
        e = _named(entities)
        names = cut(e.select("type", "n").distinct())
        self._put("members", e, "n", mode)
        self._put("ends", _ends(names), "last", mode)
        self._put("keys", self._keys_of(names), "key", mode)

    def matches(self, entities: DataFrame, mentions: DataFrame) -> DataFrame:
        """The rows of ``candidates`` that touch one of these entities (id, name, type), which need not be in the index."""
        e = cut(_named(entities))
        names = cut(e.select("type", "n").distinct())
        keys, ends = cut(self._keys_of(names)), _ends(names)
        near = _met(keys, self._get("keys", "type string, n string, key long", keys, "key"))
        begun = _begun(ends, self._get("ends", "type string, n string, initial string, last string, short boolean", ends, "last"))
        inside = _met(keys, keys).unionAll(_begun(ends, ends))  # among themselves
        close = _close(near.unionAll(begun).unionAll(inside))
        both = close.unionAll(close.select("type", F.col("nb").alias("na"), F.col("na").alias("nb"), "base")).join(names.withColumnRenamed("n", "na"), ["type", "na"], "left_semi")
        both = cut(both.unionAll(names.select("type", F.col("n").alias("na"), F.col("n").alias("nb"), F.lit(EXACT).alias("base"))))
        others = self._get("members", "id long, type string, n string", both.select(F.col("nb").alias("n")), "n").select("id", "type", "n").unionAll(e.select("id", "type", "n")).distinct()
        found = both.join(e.toDF("x", "type", "na"), ["type", "na"]).join(others.toDF("y", "type", "nb"), ["type", "nb"]).filter("x <> y")
        return _scored(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "base").distinct(), mentions)


def resolved(found: DataFrame) -> DataFrame:
    """(source_entity_id, canonical_entity_id): one step, to the highest id that a source merges with on its own."""
    return found.filter("action = 'auto'").groupBy(F.col("source").alias("source_entity_id")).agg(F.max("target").alias("canonical_entity_id"))
