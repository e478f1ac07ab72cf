"""Figures in written notes, held against the figures of record; and names of persons taken out of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A percentage as it is printed: digits, perhaps a decimal comma or point with more digits, the sign.
PERCENT = r"[0-9]{1,9}(?:[.,][0-9]{1,9})?%"
#: Rows up to which a table is broadcast, and how far a larger one is spread for hot keys.
FEW, SALTS = 100_000, 16


def few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """``df`` to be broadcast if it has at most ``rows`` rows (they are counted), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def figures(notes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, printed, value, decimals): the percentages of each text in order, from 0, with the decimals they are printed to."""
    found = F.regexp_extract_all(F.col(text), F.lit(PERCENT), F.lit(0))
    rows = notes.select(F.col(key), F.posexplode(found).alias("place", "printed"))
    number = F.replace(F.rtrim(F.col("printed"), F.lit("%")), F.lit(","), F.lit("."))
    decimals = F.length(F.regexp_extract("printed", "[.,]([0-9]+)", 1))
    return rows.select(key, "place", "printed", number.cast("double").alias("value"), decimals.alias("decimals"))


def matched(figures: DataFrame, record: DataFrame, units: float = 0.5) -> DataFrame:
    """Figures with the name of the nearest value of record (name, value) that they can be a rounding of: the difference is at most ``units`` of
    the last printed decimal. Adds ``name``, ``recorded`` and ``status`` (OK, or ORPHAN where there is none); of values equally near the first name.

    A band join without pairs of all with all: a figure as printed, once however often it occurs, and the values of record
    are dealt to buckets as wide as the band, for each number of decimals that occurs, and meet those of their own and the next buckets."""
    printed = figures.select("value", "decimals").distinct()
    digits = printed.select("decimals").distinct()
    step = F.pow(F.lit(10.0), -F.col("decimals")) * units
    dealt = record.where(F.col("value").isNotNull()).select("name", F.col("value").alias("recorded")).crossJoin(F.broadcast(digits))  # at most ten
    dealt = dealt.withColumn("bucket", F.floor(F.col("recorded") / step)).withColumn("beside", F.lit(0))
    near = printed.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("value") / step) + i for i in (-1, 0, 1)])))
    # a billionth of the band is left for the steps of doubles
    met = near.join(few(dealt), ["decimals", "bucket"]).where(F.abs(F.col("value") - F.col("recorded")) <= step * (1 + 1e-9))
    best = met.groupBy("value", "decimals").agg(F.min(F.struct(F.abs(F.col("value") - F.col("recorded")).alias("gap"), "name", "recorded")).alias("x"))
    told = figures.join(few(best.select("value", "decimals", "x.name", "x.recorded")), ["value", "decimals"], "left")
    return told.withColumn("status", F.when(F.col("name").isNull(), "ORPHAN").otherwise("OK"))


def expected(figures: DataFrame, key: str, slots: DataFrame, units: float = 0.5) -> DataFrame:
    """Each place of a note that should carry a figure, (key, place, name, recorded) in ``slots``, with what it carries: status OK, FAIL (another
    figure) or MISSING; and figures that no place asks for as EXTRA."""
    j = slots.join(figures, [key, "place"], "full")
    step = F.pow(F.lit(10.0), -F.col("decimals")) * units
    agrees = F.abs(F.col("value") - F.col("recorded")) <= step * (1 + 1e-9)
    status = F.when(F.col("name").isNull(), "EXTRA").when(F.col("value").isNull(), "MISSING").when(F.coalesce(agrees, F.lit(False)), "OK").otherwise("FAIL")
    return j.select(key, "place", "name", "printed", "recorded", status.alias("status"))


#: What a token is: a run of letters, digits, # and _, or a run of anything else.
_TOKEN = r"[\p{L}\p{N}#_]+|[^\p{L}\p{N}#_]+"


def suppressed(texts: DataFrame, key: str, text: str, names: DataFrame, label: str = "[person]") -> DataFrame:
    """The texts with every name of the dictionary (column ``name``) replaced by ``label``: whole words, case
    as written, from the left and of names that start together the longest. Adds ``n_names``. ``key`` is unique.

    The texts are read once for all names: a window as long as the longest name moves over the words, those that open with a name's first
    word are looked up at each length that a name has, and only what is a name comes back to its text. Names that do not begin with a letter, digit, # or _ match nothing."""
    names = names.select("name").where(F.regexp_like("name", F.lit(r"^[\p{L}\p{N}#_]"))).distinct().withColumn("words", F.regexp_extract_all("name", F.lit(_TOKEN), F.lit(0)))
    sizes = sorted(r.n for r in names.select(F.size("words").alias("n")).distinct().collect())  # lengths of names
    tokens = texts.withColumn("__tokens", F.coalesce(F.regexp_extract_all(F.col(text), F.lit(_TOKEN), F.lit(0)), F.array().cast("array<string>")))
    if not sizes:
        return tokens.withColumn("n_names", F.lit(0)).drop("__tokens")
    ahead = F.transform(F.sequence(F.lit(1), F.size("__tokens")), lambda i: F.slice("__tokens", i, sizes[-1]))
    windows = tokens.where(F.size("__tokens") > 0).select(key, F.posexplode(ahead).alias("at", "window"))
    first = few(names.select(F.col("words")[0].alias("word")).distinct())
    opens = windows.withColumn("word", F.col("window")[0]).join(first, "word", "left_semi")
    runs = opens.select(key, "at", "window", F.explode(F.array(*map(F.lit, sizes))).alias("length")).where(F.size("window") >= F.col("length"))
    runs = runs.select(key, "at", "length", F.array_join(F.slice("window", F.lit(1), F.col("length")), "").alias("run"))
    hits = runs.join(few(names.select(F.col("name").alias("run"))), "run", "left_semi")
    longest = hits.groupBy(key, "at").agg(F.max("length").alias("length"))
    per = longest.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "length"))).alias("__hits"))  # at most the text's own words
    j = tokens.join(per, key, "left")
    none = F.array().cast("array<struct<at:int,length:int>>")
    start = F.struct(F.lit(0).alias("free"), none.alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        taken = x["at"] < acc["free"]
        one = F.array(F.struct(x["at"].cast("int").alias("at"), x["length"].cast("int").alias("length")))
        return F.struct(F.when(taken, acc["free"]).otherwise((x["at"] + x["length"]).cast("int")).alias("free"), F.when(taken, acc["kept"]).otherwise(F.concat(acc["kept"], one)).alias("kept"))

    kept = F.when(F.col("__hits").isNull(), none).otherwise(F.aggregate("__hits", start, step)["kept"])
    j = j.withColumn("__kept", kept)
    # between two names the tokens stand as they are
    ends = F.concat(F.array(F.lit(0)), F.transform("__kept", lambda h: h["at"] + h["length"]))
    j = j.withColumn("__gaps", F.arrays_zip(ends.alias("begin"), F.concat(F.transform("__kept", lambda h: h["at"]), F.array(F.size("__tokens"))).alias("end")))
    pieces = F.transform("__gaps", lambda g: F.array_join(F.slice("__tokens", g["begin"] + 1, g["end"] - g["begin"]), ""))
    clean = F.when(F.col(text).isNull(), None).otherwise(F.array_join(pieces, label))
    columns = [clean.alias(c) if c == text else F.col(f"`{c}`") for c in texts.columns]
    return j.select(*columns, F.size("__kept").alias("n_names"))


#: Fixed pattern of a process number.
PROCESS = r"[0-9]{5}\.[0-9]{6}/[0-9]{4}-[0-9]{2}"


def cases(people: DataFrame, by: list[str], person: str, text: str) -> DataFrame:
    """Persons rolled up by case: (by, n_persons, processes): how many there are, nobody named, and the numbers of processes their
    texts cite, each once and in order."""
    cited = people.select(*by, person, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PROCESS), F.lit(0)).alias("cited"))
    persons = cited.groupBy(*by).agg(F.count_distinct(person).alias("n_persons"))
    numbers = cited.select(*by, F.explode("cited").alias("number")).distinct().groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list("number")), "; ").alias("processes"))
    on = F.lit(True)
    for c in by:
        on = on & persons[c].eqNullSafe(numbers[c])
    return persons.join(numbers, on, "left").select(*[persons[c] for c in by], "n_persons", F.coalesce("processes", F.lit("")).alias("processes"))
