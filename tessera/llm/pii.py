"""Personal data by gradient-boosted candidates.

Rules find the base spans, leftmost and non-overlapping for each kind (email, ip, card, phone). Generators
with high recall propose further spans that may overlap: numbers with unusual separators, addresses with
written-out signs, loosely written IP numbers. Boosted trees score each proposal by its format and context,
and a threshold for each kind, calibrated on rows that the trees did not see, selects those to add. Base
spans always stay; an added span never overlaps one, of added ones that overlap the likeliest stays.

The trees and thresholds are fitted on the spans of all documents. Nobody has labelled the
proposals of a corpus, so they are not taken for clean. Positive rows are base spans, rewritten as someone would
who avoids the rules, in their own context. Known negative ones are the same with a fault (a digit that breaks the
checksum, a part above 255, too few or too many digits). A first fit sets the positives apart from the faults and all
proposals, some positives among these as spies; proposals that score like spies may be hidden personal data and are
left out, the others are clean for the second fit, which is the one that scores. With fewer than ``LEAST`` rows of
either, or where no threshold reaches ``PRECISION``, nothing is added. All of it is DataFrame functions and Spark's
own trees; patterns are possessive where they repeat, so that very long texts neither recurse nor backtrack. The
fitted trees become column expressions, so that each text is read once, scored and redacted where it lies: nothing
is joined or shuffled.

Defined results: null counts as empty text (no spans); rows with null or repeated doc_id are rows like any
other; offsets are code points, ends exclusive; other columns are ignored or, in ``redact``, kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
LEAST, PRECISION, SEED = 40, 0.99, 11
#: Rows of a task of the fit.
ROWS = 50_000
#: Code points of a block of text.
BLOCK = 4096

#: The contract's patterns, so written that a run is tried once.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERATORS = {
    "number": r"(?<![0-9A-Za-z+])[(]?[0-9](?:[ ()./-]{0,2}[0-9]){6,18}+(?![0-9A-Za-z])",
    "written": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]++(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9-]++)++",
    "loose": r"(?<![0-9.,])[0-9]{1,3}(?: ?[.,] ?[0-9]{1,3}){3}(?![0-9])",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"


def named(kind: str, *more: str) -> Callable[[Column], Column]:
    """Spans of one kind as structs (kind, start, end, *more)."""
    return lambda x: F.struct(F.lit(kind).alias("kind"), *[x[c].alias(c) for c in ("start", "end", *more)])


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


#: Elements of an array that are folded at once: a fold copies its state at each step, so no long array may be part of it.
CHUNK = 64
_SPAN = "struct<start:int,end:int,s:string,before:string,after:string>"
_OPEN = "struct<kind:string,start:int,end:int,s:string,before:string,after:string>"


def running(items: str, state: dict[str, Column], kind: str, step: Callable[[Column, Column], tuple[dict[str, Column], Column]]) -> Column:
    """What ``step`` gives for each element of the array column ``items``, as it goes along it with a state: array of ``kind``. It goes chunk by
    chunk, so that the work grows with the array's length. ``items`` must be a column of the table, not an expression."""
    empty = F.array().cast(f"array<{kind}>")
    names = list(state)

    def moved(acc: Column, x: Column) -> Column:
        new = step(acc, x)[0]
        return F.struct(*[new[n].alias(n) for n in names])

    def enter(acc: Column, c: Column) -> Column:
        """The state behind a chunk, and the list of those before each."""
        now = F.element_at(acc, -1)
        return F.array_append(acc, F.aggregate(c, now, moved))

    def told(acc: Column, x: Column) -> Column:
        new, out = step(acc, x)
        return F.struct(*[new[n].alias(n) for n in names], F.array_append(acc["out"], out).alias("out"))

    last = F.floor((F.size(items) - 1) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * CHUNK + 1, CHUNK))
    states = F.aggregate(chunks, F.array(F.struct(*[c.alias(n) for n, c in state.items()])), enter)
    each = F.zip_with(chunks, F.slice(states, F.lit(1), last + 1), lambda c, s: F.aggregate(c, F.struct(*[s[n].alias(n) for n in names], empty.alias("out")), told)["out"])
    return F.when(F.size(items) > 0, F.flatten(each)).otherwise(empty)


def located(docs: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds a column for each pattern (name: pattern, where to look): its matches as structs (start, end, s, before, after) with their code points
    and the text around them. What stands between the matches gives the offsets and the surroundings, so the text is not searched from its start again."""
    t = F.col(text)
    none = F.array().cast("array<struct<gap:string,s:string>>")
    cuts = {n: F.when(where & F.regexp_like(t, F.lit(p)), F.arrays_zip(F.split(t, p, -1).alias("gap"), F.regexp_extract_all(t, F.lit(p), F.lit(0)).alias("s"))).otherwise(none) for n, (p, where) in patterns.items()}
    docs = docs.select("*", *[c.alias(n) for n, c in cuts.items()])

    def ahead(x: Column, y: Column) -> Column:
        after = F.left(F.concat(F.left(F.coalesce(y["gap"], F.lit("")), F.lit(2)), F.left(F.coalesce(y["s"], F.lit("")), F.lit(2))), F.lit(2))
        return F.struct(x["gap"].alias("gap"), x["s"].alias("s"), after.alias("after"))

    docs = docs.withColumns({n: F.zip_with(n, F.slice(n, F.lit(2), F.greatest(F.size(n), F.lit(1))), ahead) for n in patterns})

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["s"]), F.lit(0))
        before = F.right(F.concat(acc["tail"], F.right(x["gap"], F.lit(24))), F.lit(24))
        tail = F.right(F.concat(before, F.right(F.coalesce(x["s"], F.lit("")), F.lit(24))), F.lit(24))
        span = F.struct(begin.alias("start"), end.alias("end"), x["s"].alias("s"), before.alias("before"), x["after"].alias("after"))
        return {"at": end, "tail": tail}, F.when(x["s"].isNotNull(), span)

    docs = docs.withColumns({n: running(n, {"at": F.lit(0), "tail": F.lit("")}, _SPAN, step) for n in patterns})
    return docs.withColumns({n: F.filter(n, lambda x: x.isNotNull()) for n in patterns})


def scan(docs: DataFrame, text: str) -> DataFrame:
    """Adds __email, __ip, __card, __phone (base spans) and __proposed (spans of the generators that meet no base span, with their kind) to
    documents; ``text`` is not null."""
    t = F.col(text)
    digit = F.regexp_like(t, F.lit("[0-9]"))
    where = {"email": F.contains(t, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(t, F.lit("+")), "number": digit, "written": F.contains(t, F.lit("at")), "loose": digit}
    docs = located(docs, text, {f"__{n}": (p, where[n]) for n, p in (BASE | GENERATORS).items()})
    docs = docs.withColumns({
        "__ip": F.filter("__ip", lambda x: F.regexp_like(x["s"], F.lit(_IP))),
        "__card": F.filter("__card", lambda x: luhn(digits(x["s"]))),
        "__phone": F.filter("__phone", lambda x: F.length(digits(x["s"])).between(8, 15)),
    })
    # base spans and proposals by their start; going forward the farthest end of a base span, going back its nearest start tell which proposals meet one
    open_ = [F.transform(f"__{n}", named(kind, "s", "before", "after")) for n, kinds in {"number": ("phone", "card"), "written": ("email",), "loose": ("ip",)}.items() for kind in kinds]
    base = F.transform(F.concat(*[F.col(f"__{k}") for k in KINDS]), lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("k"), x["end"].alias("end"), F.lit(None).cast(_OPEN).alias("x")))
    every = F.transform(F.concat(*open_), lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("k"), x["end"].alias("end"), x.alias("x")))
    some = F.size("__number") + F.size("__written") + F.size("__loose") > 0
    docs = docs.select("*", F.when(some, F.array_sort(F.concat(base, every))).otherwise(F.array().cast(f"array<struct<start:int,k:int,end:int,x:{_OPEN}>>")).alias("__items"))
    item = f"struct<start:int,k:int,end:int,x:{_OPEN}>"

    def forward(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        is_base = x["k"] == 0
        free = is_base | (acc["reach"] <= x["start"])
        return {"reach": F.when(is_base, F.greatest(acc["reach"], x["end"])).otherwise(acc["reach"])}, F.when(free, x)

    def back(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        is_base = x["k"] == 0
        return {"next": F.when(is_base, x["start"]).otherwise(acc["next"])}, F.when(~is_base & (acc["next"] >= x["end"]), x["x"])

    docs = docs.withColumn("__items", F.reverse(F.filter(running("__items", {"reach": F.lit(0)}, item, forward), lambda x: x.isNotNull())))
    docs = docs.withColumn("__proposed", F.filter(running("__items", {"next": F.lit(2**31 - 1)}, _OPEN, back), lambda x: x.isNotNull()))
    return docs.drop("__items", *[f"__{n}" for n in GENERATORS])


def features(kind: Column, s: Column, before: Column, after: Column) -> list[Column]:
    """Format and context of a span as numbers."""
    before = F.lower(before)
    number = digits(s)
    groups = F.filter(F.split(s, "[^0-9]+"), lambda g: g != "")

    def count(pattern: str) -> Column:
        return F.regexp_count(s, F.lit(pattern))

    made = [
        F.length(number), F.length(s), count(" "), count("-"), count("[()]"), count("[.,/]"), count("[A-Za-z]"),
        F.when((F.length(number) > 12) & luhn(number), 1).otherwise(0), F.size(F.array_distinct(F.split(number, ""))), F.size(groups),
        F.coalesce(F.length(F.try_element_at(groups, F.lit(1))), F.lit(0)), F.coalesce(F.length(F.try_element_at(groups, F.lit(-1))), F.lit(0)),
        F.coalesce(F.array_max(F.transform(groups, lambda g: F.substring(g, 1, 6).cast("int"))), F.lit(0)),
        F.regexp_like(before, F.lit("[A-Za-z0-9]$")).cast("int"), F.regexp_like(before, F.lit("[\"'=]\\s*$")).cast("int"), F.regexp_like(after, F.lit("^[A-Za-z0-9]")).cast("int"),
        F.regexp_like(before, F.lit("tel|phone|call|fax|mobil")).cast("int"), F.regexp_like(before, F.lit("card|visa|credit|account")).cast("int"), F.regexp_like(before, F.lit("mail|contact|write to")).cast("int"), F.regexp_like(before, F.lit("\\bip\\b|host|server|addr")).cast("int"),
        *[(kind == k).cast("int") for k in KINDS],
    ]
    return [F.coalesce(v.cast("double"), F.lit(0.0)) for v in made]


def with_features(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.array(*features(*map(F.col, ("kind", "s", "before", "after"))))))


def probability(model: GBTClassificationModel, x: Column) -> Column:
    """What the model gives for an array of features, as a column: its trees as nested cases."""

    def walk(node: object) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(node.prediction())
        split = node.split()
        return F.when(x[split.featureIndex()] <= split.threshold(), walk(node.leftChild())).otherwise(walk(node.rightChild()))

    margin = sum((F.lit(w) * walk(tree._call_java("rootNode")) for w, tree in zip(model.treeWeights, model.trees)), F.lit(0.0))
    return 1 / (1 + F.exp(-2 * margin))


def disguised(kind: Column, s: Column, way: Column) -> Column:
    """A base span as it is written to escape the rules."""
    phone = F.regexp_replace(s, r"^\+[0-9]{1,3}[ .-]?", "")
    mail = F.when(way % 2 == 0, F.replace(s, F.lit("@"), F.lit(" (at) "))).otherwise(F.replace(F.replace(s, F.lit("@"), F.lit(" at ")), F.lit("."), F.lit(" dot ")))
    ip = F.when(way % 2 == 0, F.replace(s, F.lit("."), F.lit(" . "))).otherwise(F.replace(s, F.lit("."), F.lit(",")))
    card = F.regexp_replace(digits(s), "(.{4})(?=.)", "$1/")
    return F.when(kind == "phone", phone).when(kind == "email", mail).when(kind == "ip", ip).otherwise(card)


def faulty(kind: Column, s: Column, way: Column) -> Column:
    """A base span with a fault, so that it is none."""
    number = digits(s)
    shifted = F.concat(F.substring(number, 1, 5), F.pmod(F.substring(number, 6, 1).cast("int") + 1 + way % 8, F.lit(10)).cast("string"), F.substring(number, 7, 99))
    card = F.when(way % 2 == 0, shifted).otherwise(F.regexp_replace(shifted, "(.{4})(?=.)", "$1/"))
    ip = F.concat(F.regexp_replace(s, r"^[0-9]+", (300 + way % 600).cast("string")), F.when(way % 2 == 0, "").otherwise(" "))
    phone = F.when(way % 2 == 0, F.concat(number, F.reverse(number))).otherwise(F.substring(number, 1, 7))
    return F.when(kind == "phone", phone).when(kind == "ip", F.rtrim(ip)).when(kind == "card", card)


def labelled(docs: DataFrame) -> DataFrame:
    """Rows (kind, s, before, after, label, spy, fold) of all documents: label 1 for rewritten base spans,
    0 for those with a fault, null for proposals."""
    found = scan(docs.select(F.coalesce("text", F.lit("")).alias("t")), "t")
    known = F.concat(*[F.transform(F.col(f"__{k}"), named(k, "s", "before", "after")) for k in KINDS])
    context = F.transform(known, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after")))
    open_ = F.transform("__proposed", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after")))
    spans = found.select(F.explode(F.concat(F.transform(context, lambda x: F.struct(x.alias("x"), F.lit(True).alias("base"))), F.transform(open_, lambda x: F.struct(x.alias("x"), F.lit(False).alias("base"))))).alias("y"))
    spans = cut(spans.select("y.base", "y.x.*"), "pii-spans")
    way = F.pmod(F.xxhash64("s", "before"), F.lit(1 << 20))
    base = spans.where("base")
    true = base.select("kind", disguised(F.col("kind"), F.col("s"), way).alias("s"), "before", "after", F.lit(1.0).alias("label"))
    false = base.select("kind", faulty(F.col("kind"), F.col("s"), way).alias("s"), "before", "after", F.lit(0.0).alias("label")).where("s IS NOT NULL")
    every = true.union(false).union(spans.where("NOT base").select("kind", "s", "before", "after", F.lit(None).cast("double")))
    key = F.xxhash64("kind", "s", "before")
    return every.withColumn("fold", F.pmod(key, F.lit(4))).withColumn("spy", (F.pmod(F.shiftright(key, 8), F.lit(5)) == 0) & (F.coalesce("label", F.lit(0.0)) == 1))


def fit(docs: DataFrame) -> tuple[GBTClassificationModel, dict[str, float]] | None:
    """The trees and a threshold for each kind that can be had with PRECISION; None without enough rows."""
    ready = cut(with_features(labelled(docs)), "pii-rows")
    sizes = {r.label: r.n for r in ready.where("fold > 0").groupBy("label").agg(F.count_if(~F.col("spy")).alias("n")).collect()}  # three rows
    if min(sizes.get(1.0, 0), sizes.get(0.0, 0) + sizes.get(None, 0)) < LEAST:
        return None
    tasks = max(4, sum(sizes.values()) // ROWS)

    def boosted(rows: DataFrame) -> GBTClassificationModel:
        return GBTClassifier(labelCol="y", maxIter=10, maxDepth=3, stepSize=0.3, maxBins=32, seed=SEED).fit(rows.where("fold > 0").select("y", "features").coalesce(tasks))

    def scored(rows: DataFrame, model: GBTClassificationModel) -> DataFrame:
        return rows.withColumn("p", probability(model, vector_to_array("features")))

    first = boosted(ready.withColumn("y", F.when((F.col("label") == 1) & ~F.col("spy"), 1.0).otherwise(0.0)))
    # proposals that score like nine of ten spies are not known to be clean
    like = scored(ready.where("spy"), first).agg(F.percentile("p", F.lit(0.1))).first()[0]
    sure = F.col("label").isNotNull() | (F.col("p") < F.lit(0.5 if like is None else float(like)))
    known = cut(scored(ready, first).where(sure).select("kind", "fold", "features", F.coalesce("label", F.lit(0.0)).alias("y")), "pii-known")
    if known.where("fold > 0").select("y").distinct().count() < 2:
        return None
    model = boosted(known)
    # calibration: in each kind's unseen rows, the lowest score from which on PRECISION holds
    bins = scored(known.where("fold = 0"), model).select("kind", "y", F.floor(F.col("p") * 200).alias("bin"))
    thresholds: dict[str, float] = {}
    counts = bins.groupBy("kind", "bin").agg(F.sum("y").alias("true"), F.count("*").alias("all")).orderBy(F.desc("bin")).collect()  # 800 rows at most
    for kind in KINDS:
        true, every = 0.0, 0
        for r in (r for r in counts if r.kind == kind and r.bin >= 100):
            true, every = true + r["true"], every + r["all"]
            if every >= 20 and true / every >= PRECISION:
                thresholds[kind] = r.bin / 200
    return (model, thresholds) if thresholds else None


_ADDED = "struct<kind:string,start:int,end:int>"


def with_added(scanned: DataFrame, fitted: tuple | None) -> DataFrame:
    """Adds __added: the proposals that the trees select, (kind, start, end), likelier ones before others they overlap. Spans that hang together by
    overlaps are settled when the next one lies apart."""
    none = F.array().cast(f"array<{_ADDED}>")
    if fitted is None:
        return scanned.withColumn("__added", none)
    model, thresholds = fitted
    fed = F.transform("__proposed", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.array(*features(x["kind"], x["s"], x["before"], x["after"])).alias("f")))
    rated = F.transform(fed, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), (-probability(model, x["f"])).alias("p"), x["kind"].alias("kind")))
    limit = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(-v))])
    one = "struct<p:double,start:int,end:int,kind:string>"
    last = F.struct(F.lit(2**31 - 1).alias("start"), F.lit(2**31 - 1).alias("end"), F.lit(0.0).alias("p"), F.lit("").alias("kind"))
    scanned = scanned.withColumn("__rated", F.when(F.size("__proposed") > 0, rated))
    chosen = F.array_sort(F.filter("__rated", lambda x: x["p"] <= limit[x["kind"]]))
    scanned = scanned.withColumn("__rated", F.when(F.size("__rated") > 0, F.concat(chosen, F.array(last))).otherwise(F.array().cast("array<struct<start:int,end:int,p:double,kind:string>>")))

    def greedy(group: Column) -> Column:
        def take(acc: Column, x: Column) -> Column:
            met = F.exists(acc, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
            return F.when(met, acc).otherwise(F.array_append(acc, F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))

        return F.aggregate(F.array_sort(group), none, take)

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        apart = x["start"] >= acc["reach"]
        new = F.array(F.struct(x["p"].alias("p"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
        state = {"reach": F.greatest(acc["reach"], x["end"]), "group": F.when(apart, new).otherwise(F.concat(acc["group"], new))}
        return state, F.when(apart, greedy(acc["group"])).otherwise(none)

    added = running("__rated", {"reach": F.lit(0), "group": F.array().cast(f"array<{one}>")}, f"array<{_ADDED}>", step)
    return scanned.withColumn("__added", F.flatten(added)).drop("__rated")


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))


def _bounds(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def find(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every document; the n of
    kinds count base spans."""
    fitted = fit(docs)
    scanned = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("__t")), "__t")
    joined = with_added(scanned, fitted)
    base = F.array_join(F.concat(*[_listed(k, F.col(f"__{k}")) for k in KINDS]), ",")
    both = F.array_join(F.concat(*[_listed(k, F.array_sort(F.concat(_bounds(F.col(f"__{k}")), _bounds(F.filter("__added", of_kind(k)))))) for k in KINDS]), ",")
    return joined.select("doc_id", *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"), both.alias("spans"), F.size("__added").cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents, each span replaced by its kind in brackets; all columns are kept, n_chars is counted
    anew if there is one. Overlapping spans become one."""
    fitted = fit(docs)
    scanned = with_added(scan(docs.withColumn("__t", F.coalesce("text", F.lit(""))), "__t"), fitted)
    every = F.concat(*[F.transform(f"__{k}", named(k)) for k in KINDS], F.col("__added"))
    spans = F.array_sort(F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    listed = scanned.withColumn("__spans", spans)
    # the text in blocks, so that what stands between two spans is found without going through the text from its start
    blocks = F.when(F.size("__spans") > 0, F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    listed = listed.withColumn("__blocks", blocks)

    def between(begin: Column, end: Column) -> Column:
        first = F.floor(begin / BLOCK).cast("int")
        joined = F.array_join(F.slice("__blocks", first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
        return F.substring(joined, begin % BLOCK + 1, end - begin)

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        label = F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))
        piece = F.when(x["start"] < acc["at"], "").otherwise(F.concat(between(acc["at"], x["start"]), label))
        return {"at": F.greatest(acc["at"], x["end"])}, piece

    pieces = running("__spans", {"at": F.lit(0)}, "string", step)
    tail = F.substring(F.col("text"), F.array_max(F.transform("__spans", lambda x: x["end"])) + 1, F.length("text"))
    clean = F.when(F.size("__spans") == 0, F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), tail))
    full = listed.withColumn("__clean", clean)
    new = {"text": F.col("__clean")} | ({"n_chars": F.length("__clean").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return full.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
