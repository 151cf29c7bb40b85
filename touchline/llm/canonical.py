"""Typed names to entries of a reference list by a partition-based pigeonhole join.

Every reference string is cut into k + 1 segments. A typed string within edit distance k leaves one of them untouched, at a
place the length difference allows, so the candidates come from an equality join on (length, segment, substring); Spark's levenshtein
verifies them and an anti-join reports the rest. Nothing but built-in SQL functions is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import names
from touchline.session import cut, sized_join

UNMATCHED = "UNMATCHED"
#: Edit distance up to which segments are made, and the length from which a word may differ at all.
EDITS, LEAST_LENGTH = 2, 5
#: A word that this many entries of the list share is no name by itself (FC, United, ...).
COMMON = 10
#: Letters from which a beginning cut short by a stop can stand for a name.
LEAST_CUT = 1


def segments_of(strings: DataFrame, text: str, edits: int = EDITS) -> DataFrame:
    """All columns and ``segment``: the keys (length, number, substring) of the edits + 1 even segments of each string."""
    n, k = F.length(text), edits + 1
    numbers = F.sequence(F.lit(0), F.lit(edits))
    start = lambda i: F.floor(n * i / k).cast("int")
    keys = F.transform(numbers, lambda i: F.concat_ws("|", n, i, F.substr(F.col(text), start(i) + 1, start(i + 1) - start(i))))
    return strings.withColumn("segment", F.explode(keys))


def probes_of(strings: DataFrame, text: str, edits: int = EDITS) -> DataFrame:
    """All columns and ``segment``: the keys under which a reference string within ``edits`` of each string may be found.

    Segment i of a string whose length differs by d can have moved by at most i places, and by d plus or minus the segments after it.
    """
    n, k = F.length(text), edits + 1
    shifts = F.sequence(F.lit(-edits), F.lit(edits))

    def of_length(d: Column) -> Column:
        size = n - d  # length of the reference string

        def of_segment(i: Column) -> Column:
            start, end = F.floor(size * i / k).cast("int"), F.floor(size * (i + 1) / k).cast("int")
            moves = F.filter(shifts, lambda m: (F.abs(m) <= i) & (F.abs(m - d) <= edits - i) & (start + m >= 0) & (end + m <= n))
            return F.transform(moves, lambda m: F.concat_ws("|", size, i, F.substr(F.col(text), start + m + 1, end - start)))

        return F.when(size >= k, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(edits)), of_segment))).otherwise(F.array().cast("array<string>"))

    return strings.withColumn("segment", F.explode(F.array_distinct(F.flatten(F.transform(shifts, of_length)))))


def distance(a: Column, b: Column) -> Column:
    """Edits between two words where an exchange of letters counts as one; null beyond one edit, or if a short word differs."""
    d = F.levenshtein(a, b, EDITS)
    return F.when(d == 0, 0).when(F.least(F.length(a), F.length(b)) < LEAST_LENGTH, F.lit(None)).when(d == 1, 1).when((d == 2) & names.swapped(a, b), 1)


def reference_parts(clubs: DataFrame) -> DataFrame:
    """entry, country, short, side, place, parts, affix of each entry (columns entry, name, short, country): its own words as one, their number, the common words, its side.

    An entry with marked letters comes twice, with the letters plain and spelt out. A name of common words only has them as its own.
    """
    parts = clubs.select("entry", "country", F.translate(names.plain(F.col("short")), ". ", "").alias("short"), F.explode(F.array_distinct(F.array(names.tokens(F.col("name")), names.tokens(F.col("name"), names.spelt_out)))).alias("toks"))
    parts = cut(parts.select("entry", "country", "short", names.sides(F.col("toks")).alias("side"), F.transform(names.core(F.col("toks")), lambda t: t["t"]).alias("words")).distinct().withColumn("row", F.monotonically_increasing_id()))
    long = parts.select("row", "entry", F.posexplode("words").alias("at", "word"))
    common = long.groupBy("word").agg(F.countDistinct("entry").alias("n")).where(F.col("n") >= COMMON).select("word", F.lit(True).alias("shared"))
    told = sized_join(long, cut(common), ["word"], "left").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "word", F.coalesce("shared", F.lit(False)).alias("shared")))).alias("w"))
    some = F.exists("w", lambda x: ~x["shared"])
    text = lambda keep, by: F.array_join(F.transform(F.filter("w", keep), lambda x: x["word"]), by)
    out = parts.join(told, "row").withColumn("some", some)
    own = lambda x: ~x["shared"] | ~F.col("some")
    return out.select("entry", "country", "short", "side", text(own, "").alias("place"), F.size(F.filter("w", own)).alias("parts"), text(lambda x: ~own(x), " ").alias("affix")).where("length(place) > 0").distinct()


def match_names(typed: DataFrame, clubs: DataFrame) -> DataFrame:
    """name, country, entries: for each typed name (distinct pairs of name and country, null where unknown) that fits some entry, the entries it fits best.

    A name fits an entry if one of its words, or as many adjacent words as the entry's own name has, are the entry's own name (up to a slip of one edit or two exchanged letters, or cut short by a
    stop), its other words are the entry's common words or stand for them, and the sides are the same; or if it is the entry's short name.
    """
    # the parts of the plan are written one by one: each is small, and nothing that is used twice is computed twice
    ref = cut(reference_parts(clubs).withColumn("look", names.look_alike(F.col("place"))))
    longest = ref.agg(F.coalesce(F.max("parts"), F.lit(0)).alias("longest"))  # one row
    # the common words of the list, as a typed word is met with them
    common = cut(ref.where("affix <> ''").select(F.col("affix").alias("word")).distinct().withColumn("shared", F.lit(True)))
    q = typed.select("name", "country", names.tokens(F.col("name")).alias("toks")).withColumns({"side": names.sides(F.col("toks")), "words": names.core(F.col("toks"))})
    q = cut(q.where(F.size("words") >= 1))
    # runs of adjacent words, as long as the longest own name of the list: a bound of the list, so the work is linear in the words
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least("longest", F.size("words"))), lambda n: F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda at: F.struct(at.alias("at"), n.alias("n")))))
    words = q.join(F.broadcast(longest), F.lit(True)).where("longest > 0").select("name", "country", "side", "words", F.explode(runs).alias("run"))
    words = words.select("*", F.expr("slice(words, run.at + 1, run.n)").alias("inside"), F.expr("filter(words, (w, i) -> i < run.at or i >= run.at + run.n)").alias("rest"))
    words = words.where("not exists(slice(inside, 1, run.n - 1), w -> w.dot)")  # only the last word of a run may be cut short
    words = words.select("name", "country", "side", "rest", F.col("run.n").alias("n"), F.array_join(F.transform("inside", lambda t: t["t"]), "").alias("word"), F.element_at("inside", -1)["dot"].alias("dot"), F.get("rest", F.lit(0))["t"].alias("beside"))
    words = sized_join(words, common, ["word"], "left").where("shared is null").drop("shared")
    words = sized_join(words, common.toDF("beside", "beside_shared"), ["beside"], "left")
    words = cut(words.select("name", "country", "side", "rest", "n", names.look_alike(F.col("word")).alias("look"), "dot", F.coalesce("beside_shared", F.lit(False)).alias("beside_shared")))
    # whole words against whole places, cut words against beginnings of places: one join, told apart by the key
    beginnings = ref.select("entry", "look", F.explode(F.sequence(F.lit(LEAST_CUT), F.greatest(F.length("look") - 1, F.lit(LEAST_CUT)))).alias("n")).select("entry", F.substr("look", F.lit(1), F.col("n")).alias("form"), F.lit(True).alias("dot"))
    forms = cut(ref.select("entry", F.col("look").alias("form"), F.lit(False).alias("dot")).unionByName(beginnings).distinct())
    distinct_words = words.select("look", "dot").distinct()
    found = probes_of(distinct_words, "look").join(segments_of(forms.select("form", F.col("dot").alias("form_dot")).distinct(), "form"), "segment")
    found = found.where(F.col("dot") == F.col("form_dot")).select("look", "dot", "form", distance(F.col("look"), F.col("form")).alias("edits")).where("edits is not null").distinct()
    # words too short for segments only stand for themselves
    found = found.unionByName(distinct_words.where("length(look) <= 2").select("look", "dot", F.col("look").alias("form"), F.lit(0).alias("edits")))
    found = cut(found.join(forms, ["form", "dot"]).groupBy("look", "dot", "entry").agg(F.min("edits").alias("edits")))
    pairs = words.join(found, ["look", "dot"]).join(ref.select("entry", F.col("country").alias("home"), F.col("side").alias("entry_side"), "affix", "parts"), "entry").where("n = 1 or n = parts")
    pairs = pairs.where(F.col("country").isNull() | (F.col("country") == F.col("home"))).where(F.col("side") == F.col("entry_side"))
    other = F.get("rest", F.lit(0))
    typo = distance(names.look_alike(other["t"]), names.look_alike(F.col("affix")))
    affix = (
        F.when(F.size("rest") == 0, 2)
        .when(F.array_join(F.transform("rest", lambda t: t["t"]), " ") == F.col("affix"), 0)
        .when(F.col("affix") == "", F.lit(None))
        # the common word written out: each of its letters begins a word, or it abbreviates one
        .when(F.size("rest") > 1, F.when(F.array_join(F.transform("rest", lambda t: F.substring(t["t"], 1, 1)), "") == F.col("affix"), 1))
        .when((F.length("affix") <= 3) & (F.length(other["t"]) >= 6) & ~F.col("beside_shared") & names.short_for(F.col("affix"), F.lit(False), other["t"]), 1)
        .when(names.short_for(other["t"], other["dot"], F.col("affix")), 1)
        .when(~other["dot"] & typo.isNotNull(), 1)
    )
    pairs = pairs.withColumn("cost", F.col("edits") * 10 + F.when(F.col("dot"), F.when(F.length("look") < 3, 7).otherwise(5)).otherwise(0) + affix).where("cost is not null").select("name", "country", "entry", "cost")
    # a name of one word may be an entry's short name
    codes = q.where((F.size("words") == 1) & (F.col("side") == "")).select("name", "country", F.get("words", F.lit(0))["t"].alias("short"))
    codes = codes.join(ref.where("side = '' and short <> ''").select("short", "entry", F.col("country").alias("home")).distinct(), "short").where(F.col("country").isNull() | (F.col("country") == F.col("home"))).select("name", "country", "entry", F.lit(1).alias("cost"))
    every = pairs.unionByName(codes).groupBy("name", "country", "entry").agg(F.min("cost").alias("cost"))
    return every.groupBy("name", "country").agg(F.collect_list(F.struct("cost", "entry")).alias("all")).select("name", "country", F.expr("transform(filter(all, x -> x.cost = array_min(transform(all, y -> y.cost))), x -> x.entry)").alias("entries"))


def map_names(records: DataFrame, key: str, texts: list[str], country: Column, clubs: DataFrame) -> DataFrame:
    """key, entry: for each record the one entry that its typed names stand for, else UNMATCHED.

    Names that fit no entry say nothing; of names that fit several, the entries all of them share count. UNMATCHED where no entry or more
    than one is left. Null, empty and blank names fit nothing; a null country leaves every country open, or the one named in brackets in the
    name. Repeated records give one row, null keys none; an empty reference list leaves all unmatched; an empty table gives no rows.
    """
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), country.alias("country"), F.array(*[F.col(t) for t in texts]).alias("names")).distinct()
    long = rows.select("key", "country", F.explode("names").alias("name")).where("name is not null and trim(name) <> ''")
    # a country named in brackets within the name, where the record has none
    codes = clubs.select("country", names.plain(F.col("country_name")).alias("full")).where("country is not null").distinct()
    codes = codes.select(F.explode(F.array(names.plain(F.col("country")), F.col("full"))).alias("hint"), F.col("country").alias("hinted")).where("hint is not null").dropDuplicates(["hint"])
    hints = codes.agg(F.map_from_entries(F.collect_list(F.struct("hint", "hinted"))).alias("hints"))  # as many entries as there are countries
    long = long.join(F.broadcast(hints), F.lit(True), "left")
    inside = F.get(F.filter(F.transform(names.bracketed(F.col("name")), lambda b: F.try_element_at("hints", b)), lambda c: c.isNotNull()), F.lit(0))
    given = F.coalesce(F.try_element_at("hints", names.plain(F.col("country"))), F.when(F.trim("country") == "", F.lit(None)).otherwise(F.col("country")))
    long = long.select("key", "name", F.coalesce(given, inside).alias("country"))
    fits = cut(match_names(long.select("name", "country").distinct(), clubs))
    # names recur, and one may make up much of the table; a missing country is a value of its own
    filled = lambda df: df.withColumn("place", F.coalesce(F.concat(F.lit("in "), "country"), F.lit("anywhere"))).drop("country")
    joined = sized_join(filled(long), cut(filled(fits)), ["name", "place"])
    sets = joined.select("key", "entries").distinct().groupBy("key").agg(F.collect_list("entries").alias("sets"))
    shared = sets.select("key", F.aggregate(F.slice("sets", 2, 2**30), F.get("sets", F.lit(0)), lambda a, b: F.array_intersect(a, b)).alias("shared"))
    matched = shared.where(F.size("shared") == 1).select("key", F.get("shared", F.lit(0)).alias("entry"))
    unmatched = rows.select("key").distinct().join(matched, "key", "left_anti").select("key", F.lit(UNMATCHED).alias("entry"))
    return matched.unionByName(unmatched).withColumnRenamed("key", key)


def club_entries(teams: DataFrame) -> DataFrame:
    """entry, name, short, country, country_name of a table of clubs, one row per spelling."""
    return teams.select(F.col("team_id").alias("entry"), F.col("canonical_name").alias("name"), F.col("short_name").alias("short"), F.col("country_code").alias("country"), "country_name").where("entry is not null and name is not null").distinct()


