"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select redactions.

Everything that touches rows is a DataFrame expression. The driver sees counts of feature cells, whose number is
bounded by the features' ranges, and fits the trees on them.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# Fixed values of the contract, written so that no start inside a run of the first class is tried: a match starts
# where such a run starts or where the last match ended. Repeats are possessive where nothing is given back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Runs that hold a card, cut below where two separators meet.
CARD_RUN = r"[0-9][0-9 -]{15,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# High-recall generators beyond the contract: written-out signs, other separators, no country sign, other lengths.
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?@ ?| ?[\[(]at[\])] ?| at )[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]++){1,8}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]| \. |\.)[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9](?:[ .-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+.])(?:00|\(?)[0-9][ ().0-9-]{5,18}[0-9](?![0-9.])",
}
EMAIL_SIGN = r"@|[\[(]at[\])]| at [A-Za-z0-9-]+ dot "
# Words before a span that speak for or against personal data.
FOR = r"(?i)(?:e-?mail|mail|contact|write|reach|phone|tel|call|mobile|fax|cell|card|visa|credit|ip|address|host|login)[^a-z0-9]{0,3}(?:[a-z]{1,4}[^a-z0-9]{1,2})?$"
AGAINST = r"(?i)(?:version|isbn|issn|doi|serial|order|invoice|page|section|chapter|figure|table|sha1|md5|hash|no|nr|id)[^a-z0-9]{0,3}$"
FEATURES = ("kind", "digits", "marks", "shape", "valid", "before", "left", "right")
ROUNDS = 20
RATE = 0.3
CONTEXT = 24


def of(f, *first):
    """f with its first arguments given, as a function of one column."""
    return lambda c: f(*first, c)


def let(value: Column, then) -> Column:
    """The value, worked out once, handed to a function of a column."""
    return F.transform(F.array(value), then)[0]


SPAN = "array<struct<start:int,stop:int,s:string,before:string,after:string>>"
# Elements that a scan appends to one list before it begins the next.
BLOCK = 512


def scan(items: Column, state: Column, kind: str, step) -> Column:
    """What `step(state, item)` gives for the items in order: the next state, and an array of results to append.

    Results are kept in blocks, so that the work grows with the items and not with their square. `items` is a column of the
    table, as each block is taken from it.
    """
    none = F.array().cast(kind)

    def each(acc, x):
        after, out = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out"))

    def block(acc, i):
        own = F.aggregate(F.slice(items, i * BLOCK + 1, BLOCK), F.struct(acc["now"]["state"].alias("state"), none.alias("out")), each)
        return F.struct(own.alias("now"), F.concat(acc["done"], F.array(acc["now"]["out"])).alias("done"))

    first = F.struct(F.struct(state.alias("state"), none.alias("out")).alias("now"), F.array().cast(f"array<{kind}>").alias("done"))
    ended = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), first, block)
    return F.when(F.size(items) > 0, let(ended, lambda e: F.flatten(F.concat(e["done"], F.array(e["now"]["out"]))))).otherwise(none)


def between(matches: Column, pieces: Column) -> Column:
    """Matches `s` with the text `gap` before each and the two characters `after` it.

    `pieces` is what the same pattern splits the text into, one more than matches.
    """
    n = F.size(matches)
    behind = F.concat(F.slice(matches, 2, n), F.array(F.lit("")))
    after = F.zip_with(F.slice(pieces, 2, n), behind, lambda gap, s: F.substring(F.concat(gap, s), 1, 2))
    items = F.zip_with(F.slice(pieces, 1, n), matches, lambda gap, s: F.struct(gap.alias("gap"), s.alias("s")))
    items = F.zip_with(items, after, lambda x, c: F.struct(x["gap"].alias("gap"), x["s"].alias("s"), c.alias("after")))
    return F.when(n > 0, items).otherwise(F.array().cast("array<struct<gap:string,s:string,after:string>>"))


def placed(items: Column) -> Column:
    """Matches with their code points, the CONTEXT characters before them and the two behind.

    Places are running sums of lengths, so no match looks through the text from its beginning.
    """

    def step(state, x):
        start, before = state["at"] + F.length(x["gap"]), F.right(F.concat(state["tail"], x["gap"]), F.lit(CONTEXT))
        stop = start + F.length(x["s"])
        own = F.struct(start.alias("start"), stop.alias("stop"), x["s"].alias("s"), before.alias("before"), x["after"].alias("after"))
        return F.struct(stop.alias("at"), F.right(F.concat(before, x["s"]), F.lit(CONTEXT)).alias("tail")), F.array(own)

    return scan(items, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), SPAN, step)


def cut_runs(runs: Column) -> Column:
    """Placed runs of digits and separators, cut where two separators meet; parts too short for a card go."""

    def parts(run):
        pieces = F.split(F.regexp_replace(run["s"], "[ -]+$", ""), "[ -]{2,}")
        first = F.struct(F.lit(1).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc, s):
            def add(p):
                before = F.right(F.concat(run["before"], F.substring(run["s"], F.lit(1), p - 1)), F.lit(CONTEXT))
                after = F.substring(F.concat(F.substring(run["s"], p + F.length(s), F.lit(2)), run["after"]), 1, 2)
                start = run["start"] + p - 1
                own = F.struct(start.alias("start"), (start + F.length(s)).alias("stop"), s.alias("s"), before.alias("before"), after.alias("after"))
                return F.struct((p + F.length(s)).alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

            return let(F.call_function("locate", s, run["s"], acc["at"]), add)

        return F.aggregate(F.filter(pieces, lambda s: F.length(s) >= 16), first, step)["out"]

    return F.flatten(F.transform(runs, parts))


EVENT = "struct<start:int,stop:int,own:int,kind:int,s:string,before:string,after:string>"


def events(base: Column, proposals: Column) -> Column:
    """Base spans (own = 0) and proposals (own = 1) in the order of their starts; none if there is no proposal."""
    text = F.lit("")

    def solid(b):
        return F.struct(b["start"], b["stop"], F.lit(0).alias("own"), F.lit(0).alias("kind"), text.alias("s"), text.alias("before"), text.alias("after"))

    def loose(c):
        return F.struct(c["start"], c["stop"], F.lit(1).alias("own"), c["kind"], c["s"], c["before"], c["after"])

    every = F.array_sort(F.concat(F.transform(base, solid), F.transform(proposals, loose)))
    return F.when(F.size(proposals) > 0, every).otherwise(F.array().cast(f"array<{EVENT}>"))


def beyond(every: Column) -> Column:
    """Events without the proposals that begin before a base span ahead of them ends; last first."""

    def up(far, e):
        stays = (e["own"] == 0) | (far <= e["start"])
        return F.when(e["own"] == 0, F.greatest(far, e["stop"])).otherwise(far), F.when(stays, F.array(e)).otherwise(F.array().cast(f"array<{EVENT}>"))

    return F.reverse(scan(every, F.lit(0), f"array<{EVENT}>", up))


def ahead(left: Column) -> Column:
    """The proposals among what `beyond` leaves that end before the next base span begins, first ones first."""

    def down(near, e):
        stays = (e["own"] == 1) & (near >= e["stop"])
        return F.when(e["own"] == 0, e["start"]).otherwise(near), F.when(stays, F.array(e)).otherwise(F.array().cast(f"array<{EVENT}>"))

    return F.reverse(scan(left, F.lit((1 << 31) - 1), f"array<{EVENT}>", down))


def found(text: Column, pattern: str, when: Column) -> Column:
    return F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def worth(c, i):
        d = c.cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), worth)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def small_parts(s: Column) -> Column:
    """All numbers in the string are at most 255."""
    parts = F.transform(F.split(s, r"[^0-9]+"), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def valid_of(kind: str, s: Column) -> Column:
    n = F.length(digits_of(s))
    return {
        "email": F.lit(True),
        "ip": small_parts(s),
        "card": n.between(16, 19) & luhn(digits_of(s)),
        "phone": n.between(8, 15),
    }[kind]


def features(kind: str, c: Column, label: Column) -> Column:
    """A candidate with its format and context, all in small whole numbers. A phone's country sign is left out:
    it is what the base pattern asks for, and the point is to find spans that are alike otherwise."""
    s = c["s"]
    own = F.regexp_replace(s, r"^(?:\+|00)[0-9]{0,3}[ .-]*", "") if kind == "phone" else s
    n = F.length(digits_of(own))
    context = c["before"]
    before = F.when(context.rlike(AGAINST), 0).when(context.rlike(FOR), 2).otherwise(1)
    shape = {
        "email": s.rlike("@[^ ]+$"),
        "ip": s.rlike(r"^[0-9.]+$"),
        "card": s.rlike("^[0-9]{13,19}$|^(?:[0-9]{4}[ -]?){3,4}[0-9]{1,4}$"),
        "phone": s.rlike(r"[0-9]{3}\)?[ .-]+[0-9]{3}[ .-]+[0-9]{4}$"),
    }[kind]
    return F.struct(
        c["start"].alias("start"),
        c["stop"].alias("stop"),
        F.lit(KINDS.index(kind)).alias("kind"),
        F.least(n, F.lit(20)).alias("digits"),
        F.least(F.length(F.regexp_replace(own, "[A-Za-z0-9]", "")), F.lit(8)).alias("marks"),
        shape.cast("int").alias("shape"),
        valid_of(kind, s).cast("int").alias("valid"),
        before.alias("before"),
        context.rlike(r"[A-Za-z0-9_/=#$.-]$").cast("int").alias("left"),
        c["after"].rlike(r"^(?:[A-Za-z0-9_/=#$%-]|\.[0-9])").cast("int").alias("right"),
        label.alias("label"),
    )


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """`text`, the columns to keep, `base` (kind, start, stop of valid base spans) and `proposed`, all per document.

    Proposed are the base pattern's matches, labelled by their check, and the generators' spans that meet no valid
    base span, labelled 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, text.alias("text"))
    t = F.col("text")
    some = t.rlike("[0-9]")
    base = {
        "email": (EMAIL, t.contains("@")),
        "ip": (IP, some),
        "card": (CARD_RUN, some),
        "phone": (PHONE, some & t.contains("+")),
    }
    more = {k: (MORE[k], t.rlike(EMAIL_SIGN) if k == "email" else some) for k in KINDS}
    searches = {f"{g}_{k}": search for g, group in (("m", base), ("g", more)) for k, search in group.items()}
    # One step each, so that no search is written out, and made, twice.
    rows = rows.select("*", *[found(t, pattern, when).alias(c) for c, (pattern, when) in searches.items()])
    rows = rows.select("*", *[F.when(F.size(c) > 0, F.split(t, p)).alias(f"p{c}") for c, (p, _) in searches.items()])
    rows = rows.select(*keep, "text", *[between(F.col(c), F.col(f"p{c}")).alias(c) for c in searches])
    rows = rows.select(*keep, "text", *[placed(F.col(c)).alias(c) for c in searches])
    rows = rows.withColumn("m_card", F.when(F.size("m_card") > 0, cut_runs(F.col("m_card"))).otherwise(F.col("m_card")))

    def valid(kind, c):
        return valid_of(kind, c["s"])

    def bare(kind, c):
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"))

    def tagged(kind, c):
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), *[c[f].alias(f) for f in ("start", "stop", "s", "before", "after")])

    good = [F.transform(F.filter(f"m_{k}", of(valid, k)), of(bare, k)) for k in KINDS]
    loose = [F.transform(f"g_{k}", of(tagged, k)) for k in KINDS]
    rows = rows.select("*", F.concat(*good).alias("base"), F.concat(*loose).alias("loose"))
    rows = rows.withColumn("every", events(F.col("base"), F.col("loose")))
    rows = rows.withColumn("left", beyond(F.col("every"))).withColumn("free", ahead(F.col("left")))

    def checked(kind, c):
        return features(kind, c, valid_of(kind, c["s"]).cast("int"))

    def proposed(kind, c):
        return features(kind, c, F.lit(0))

    def is_kind(kind, c):
        return c["kind"] == KINDS.index(kind)

    parts = [F.transform(f"m_{k}", of(checked, k)) for k in KINDS]
    parts += [F.transform(F.filter("free", of(is_kind, k)), of(proposed, k)) for k in KINDS]
    return rows.select("text", *keep, "base", F.concat(*parts).alias("proposed"))


def split_at(x, g, h):
    """The best (gain, feature, threshold) for leaves with gradients g and curvatures h."""
    best = (1e-9, 0, 0)
    whole = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= t
            a, b = g[low].sum() ** 2 / (h[low].sum() + 1), g[~low].sum() ** 2 / (h[~low].sum() + 1)
            best = max(best, (a + b - whole, f, int(t)))
    return best


def grow(x, g, h, depth):
    """A tree as a number, or (feature, threshold, low, high)."""
    leaf = float(RATE * g.sum() / (h.sum() + 1))
    if depth == 0 or len(x) < 2:
        return leaf
    gain, f, t = split_at(x, g, h)
    if gain <= 1e-9:
        return leaf
    low = x[:, f] <= t
    return f, t, grow(x[low], g[low], h[low], depth - 1), grow(x[~low], g[~low], h[~low], depth - 1)


def value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, value(low, x), value(high, x))


def boost(x: np.ndarray, yes: np.ndarray, no: np.ndarray) -> dict:
    """Boosted trees of depth 3 on cells with counts, and for each kind the least probability at which at least
    half of the proposals are base spans; a kind without base spans selects none (2.0)."""
    least = dict.fromkeys(range(len(KINDS)), 2.0)
    if not yes.sum():
        return {"bias": 0.0, "trees": [], "least": least}
    n = yes + no
    bias = float(np.log((yes.sum() + 0.5) / (no.sum() + 0.5)))
    score, trees = np.full(len(x), bias), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x, yes - n * p, n * p * (1 - p), 3)
        trees.append(tree)
        score = score + value(tree, x)
    p = 1 / (1 + np.exp(-score))
    for kind in least:
        own = x[:, 0] == kind
        for t in np.unique(p[own])[::-1]:
            top = own & (p >= t)
            if yes[top].sum() * 2 < n[top].sum() or t < 0.5:
                break
            least[kind] = float(t) - 1e-9
    return {"bias": bias, "trees": trees, "least": least}


def train(docs: DataFrame) -> dict:
    """Fit on every proposal of the table, counted by cell of features."""
    # Outer, as Spark would else write out all of `proposed` once more as a filter on its size.
    cells = candidates(docs).select(F.inline_outer("proposed")).where("kind IS NOT NULL")
    by = cells.groupBy(*FEATURES).agg(F.sum("label").alias("yes"), F.count(F.lit(1)).alias("n"))
    got = sorted(by.collect())
    x = np.array([[r[f] for f in FEATURES] for r in got], int).reshape(-1, len(FEATURES))
    yes = np.array([r["yes"] for r in got], float)
    return boost(x, yes, np.array([r["n"] for r in got], float) - yes)


def tree_column(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, t, low, high = tree
    return F.when(c[FEATURES[f]] <= t, tree_column(low, c)).otherwise(tree_column(high, c))


def probability(model: dict, c: Column) -> Column:
    total = F.lit(model["bias"])
    for tree in model["trees"]:
        total = total + tree_column(tree, c)
    return 1 / (1 + F.exp(-total))


def find(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """`text`, the columns to keep, `base` and `spans` (kind, start, stop), each by kind, then start.

    Spans are the base ones and every proposal at or above its kind's threshold; a null text has none.
    """
    rows = candidates(docs, *keep)

    def chosen(c):
        bar = F.lit(2.0)
        for kind, t in model["least"].items():
            bar = F.when(c["kind"] == kind, F.lit(t)).otherwise(bar)
        return (c["label"] == 0) & (probability(model, c) >= bar)

    def bare(c):
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"))

    more = F.transform(F.filter("proposed", chosen), bare)
    both = F.when(F.size("proposed") > 0, F.array_sort(F.concat("base", more))).otherwise(F.col("base"))
    rows = rows.select("text", *keep, "base", both.alias("both"))
    # Equal spans are neighbours by now; array_distinct would compare all with all.
    spans = F.filter("both", lambda s, i: (i == 0) | (s != F.get("both", i - 1)))
    return rows.select("text", *keep, "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        between = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, between).otherwise(acc["out"]).alias("out"))

    done = let(F.aggregate(ordered, first, step), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: counts of base spans by kind, the digest of their list, and the list of all spans.

    `docs` needs `doc_id, text`; further columns are ignored. A null text is empty and has no spans; null ids and
    repeated rows keep their rows. No row is shuffled: a document's spans are worked out where it is read. Texts are used
    whole; time on one text grows with its length and its matches (and with the square of the cards that only separators part).
    """
    rows = find(docs, train(docs), "doc_id")

    def is_kind(i, b):
        return b["kind"] == i

    counts = [F.size(F.filter("base", of(is_kind, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return personal_data(docs)
