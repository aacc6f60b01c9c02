"""Personal data by patterns and by bootstrapped contextual extraction, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of four kinds of identifiers that pass their checks.  They seed the
bootstrapping: the one to GRAM words before and after identifiers are lexical patterns, typed by side and kind; a
pattern's confidence is the share of all its occurrences in the corpus at which known identifiers of the kind stand, and
an unknown token of a kind's shape gets the score 1 - product of (1 - confidence) over the strongest pattern of either
side that it occurs with.  Tokens that score high become known, patterns are scored again, and so on until nothing new is
accepted; the tokens known at the end are spans wherever they stand.  Candidates are unbroken and spaced numbers,
identifiers with letters and digits (of kind card or phone, whichever context accepts them) and forms of e-mail addresses
that are no base span.

One pass over the texts finds all matches, and cheap tests keep the costly patterns from texts that can't have any; a
second pass counts those patterns that stand beside enough tokens, and of its words only theirs leave a task.  Iterations
run over the table of edges between patterns and instances.  Only rows with a match ever meet their spans in a join.

Base patterns are written so that a match takes time linear in the text and equals the plain pattern's match: a digit
run's match begins at the run's first digit, and an e-mail's local part where its run of characters begins or the last
match ended.

Defined results: null text is empty and has no spans; repeated rows, also of null doc_id, get spans of their own
texts; overlapping spans all stay; an empty table gives no rows; other columns, whatever their names, are not read, and
kept by masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvello.llm.common import discard, hidden, materialise

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the base spans, in Java's syntax.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_CHECK = r"^(?:0++|0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]))(?:\.0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])|\.0++){3}$"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Tokens with the shape of an identifier: digits and their punctuation between white space, bars or brackets.
TOKEN = r"(?<![^\s|(])[0-9][0-9().-]{6,}+(?=[^0-9A-Za-z\s|]*+(?:[\s|]|\z))"
_LEFT, _RIGHT = r"(?<![^\s|(\[\"'<:=#])", r"(?=[^0-9A-Za-z\s|]*+(?:[\s|]|\z))"
_GROUP = r"[(]?[0-9][0-9().-]*+" + _RIGHT
#: Two or more groups of digits with single blanks between them.
SPACED = rf"{_LEFT}{_GROUP}(?: {_GROUP})++"
#: A word of letters and at least a digit, or groups that begin as an IBAN does.
LETTERED = rf"{_LEFT}(?:[A-Z]{{2}}[0-9]{{2}}(?: [A-Z0-9]{{1,4}}(?![A-Za-z0-9]))++|(?=[0-9.-]*+[A-Za-z])(?=[A-Za-z.-]*+[0-9])[A-Za-z0-9][A-Za-z0-9.-]{{5,}}+){_RIGHT}"
_NAME = r"[\p{L}\p{N}_%+-]"
#: Addresses without a dot in the host, with other letters, or with at and dot as words.
ADDRESS = rf"{_LEFT}{_NAME}++(?:\.{_NAME}++)*+(?:(?:@| ?[(\[{{](?i:at)[)\]}}] ?){_NAME}++(?:(?:\.| ?[(\[{{](?i:dot)[)\]}}] ?| (?i:dot) ){_NAME}++)*+| (?i:at) {_NAME}++(?:(?:\.| (?i:dot) ){_NAME}++)++)"
CANDIDATES = {"token": TOKEN, "spaced": SPACED, "lettered": LETTERED, "address": ADDRESS}

#: Occurrences and different instances that a pattern needs, its least confidence, and the least score of what is accepted.
SUPPORT, INSTANCES, CONFIDENCE, ACCEPT = 5, 3, 0.5, 0.7
#: Words of a pattern at most.
GRAM = 3
#: Patterns that are sent to all tasks, more of them meet the corpus in a join; and last words of patterns that texts are
#: searched for before anything leaves a row, with more of them all runs of words do.
SENT, ENDINGS = 100_000, 1000
#: Characters beside a match in which its words are looked for first.
_CONTEXT = 60
#: What a text must have for a pattern to match anywhere.
_DIGIT, _AT = "[0-9]", rf"@|[(\[{{](?i:at)[)\]}}]| (?i:at) {_NAME}++(?:\.| (?i:dot) ){_NAME}"
_PUNCTUATION = ".,;:!?|\"'()[]{}<>$%&*#=\n\r\t"


def _beside(gap: Column, before: bool) -> Column:
    """The end or beginning of a gap that has its GRAM words next to the match whole."""
    part = F.right(gap, F.lit(_CONTEXT)) if before else F.left(gap, F.lit(_CONTEXT))
    return F.when((F.length(gap) <= _CONTEXT) | (F.size(_words(part)) > GRAM), part).otherwise(gap)


def matches(text: Column, pattern: str, possible: Column) -> Column:
    """All leftmost non-overlapping matches in order: (text, gap since the last one's end, text before, text after); null if none."""
    m, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    each = F.arrays_zip(m.alias("m"), F.slice(gaps, F.lit(1), F.size(gaps) - 1).alias("gap"), F.slice(gaps, F.lit(2), F.size(gaps) - 1).alias("next"))
    found = F.transform(each, lambda x: F.struct(x["m"].alias("text"), F.length(x["gap"]).alias("gap"), _beside(x["gap"], True).alias("before"), _beside(x["next"], False).alias("after")))
    return F.when(possible, F.when(text.rlike(pattern), found))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    reverse = F.reverse(digits)
    value = lambda i: F.substring(reverse, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, value(i)).when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def _sound(kind: Column, text: Column) -> Column:
    """Whether a match passes its kind's check."""
    digits = _digits(text)
    return F.when(kind == "ip", text.rlike(IP_CHECK)).when(kind == "card", luhn(digits)).when(kind == "phone", F.length(digits).between(9, 15)).otherwise(kind == "email")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.lower(text), _PUNCTUATION, " " * len(_PUNCTUATION)), " ", -1), lambda w: w != "")


def _shapes(token: Column) -> Column:
    """The kinds whose shape a token has that is no base span."""
    n, lettered = F.length(_digits(token)), token.rlike("^[A-Za-z0-9. -]*[A-Za-z][A-Za-z0-9. -]*$") & (F.length(token) >= 6)
    one = lambda kind, when: F.when(when, F.array(F.lit(kind))).otherwise(F.array().cast("array<string>"))
    ip, number = token.rlike(r"^[0-9]++(\.[0-9]++){3}$"), token.rlike("^[(]?[0-9][0-9(). -]*$")
    card, phone = token.rlike("^[0-9 -]+$") & n.between(13, 19), number & n.between(7, 15)
    return F.when(ip, one("ip", ip)).otherwise(F.concat(one("card", card | (lettered & (n >= 4))), one("phone", phone | (lettered & (n >= 4)))))


def scanned(docs: DataFrame, keep: list[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (row, the columns ``keep``, matched: whether there is any match) and occurrences (row, kind, base, start, end,
    text, before and after: arrays of words), both of written tables.

    One pass reads the texts.  What it found is written, and offsets are running sums over each row's matches.
    """
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True)) | CANDIDATES
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    tested = docs.select(*(F.col(f"`{c}`") for c in keep), body.alias("__body"), body.contains("@").alias("__mail"), body.contains("+").alias("__plus"), body.rlike(_DIGIT).alias("__digit"), body.rlike(_AT).alias("__at"))
    gates = {"email": "__mail", "phone": "__plus", "address": "__at"}
    read = tested.select(F.monotonically_increasing_id().alias("row"), *(F.col(f"`{c}`") for c in keep), *(matches(F.col("__body"), p, F.col(gates.get(k, "__digit"))).alias(f"__{k}") for k, p in patterns.items()))
    read = materialise(read, "pii-matches")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"__{k}").alias("found")) for k in patterns))
    some = F.coalesce(*(F.col(f"__{k}") for k in patterns)).isNotNull()
    each = read.where(some).select("row", F.explode(kinds).alias("k")).select("row", "k.kind", F.posexplode("k.found").alias("i", "m")).select("row", "kind", "i", "m.*")
    so_far = Window.partitionBy("row", "kind").orderBy("i")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.length("text")).over(so_far).cast("int")).withColumn("start", F.col("end") - F.length("text"))
    candidate = F.col("kind").isin(*CANDIDATES)
    base = ~candidate & _sound(F.col("kind"), F.col("text"))
    # Candidates end with a letter or digit; base matches that fail their check are no spans but may be tokens too.
    placed = placed.select("row", F.when(candidate, F.when(F.col("kind") == "address", "address").otherwise("")).otherwise(F.col("kind")).alias("kind"), base.alias("base"), "start", F.when(candidate, F.regexp_replace("text", r"[^\p{L}\p{N}]++$", "")).otherwise(F.col("text")).alias("text"), "before", "after")
    placed = placed.where(F.col("base") | F.col("kind").isin("", "address")).withColumn("end", (F.col("start") + F.length("text")).cast("int"))
    own_end, own_start = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    held = F.coalesce(F.max(own_end).over(order.rowsBetween(Window.unboundedPreceding, 0)) > F.col("start"), F.lit(False)) | F.coalesce(F.min(own_start).over(order.rowsBetween(1, Window.unboundedFollowing)) < F.col("end"), F.lit(False))
    kinds = F.when(F.col("base"), F.array("kind")).when(F.col("kind") == "address", F.array(F.lit("email"))).otherwise(_shapes(F.col("text")))
    found = placed.withColumn("held", held).where("base OR NOT held").select("row", F.explode(kinds).alias("kind"), "base", "start", "end", "text", _words(F.col("before")).alias("before"), _words(F.col("after")).alias("after"))
    rows = read.select("row", *(F.col(f"`{c}`") for c in keep), some.alias("matched"))
    rows.corvello_path = read.corvello_path
    return rows, materialise(found, "pii-occurrences")


def _grams(words: Column, n: int) -> Column:
    """All runs of n words."""
    if n == 1:
        return words
    run = lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), run)).otherwise(F.array().cast("array<string>"))


def edges(tokens: DataFrame) -> DataFrame:
    """(kind, text, side, gram, length, n, seed): patterns that instances occur with, and how often.  Written."""
    last = lambda n: F.array_join(F.slice("before", F.size("before") - (n - 1), F.lit(n)), " ")
    first = lambda n: F.array_join(F.slice("after", F.lit(1), F.lit(n)), " ")
    one = lambda side, gram, n: F.when(F.size(side) >= n, F.struct(F.lit(side).alias("side"), gram.alias("gram"), F.lit(n).alias("length")))
    patterns = F.array(*(x for n in range(1, GRAM + 1) for x in (one("before", F.when(F.size("before") >= n, last(n)), n), one("after", first(n), n))))
    each = tokens.select("kind", "text", F.col("base").alias("seed"), F.explode(F.filter(patterns, lambda p: p.isNotNull())).alias("p")).select("kind", "text", "seed", "p.*")
    most = 2 * GRAM * tokens.count()
    return materialise(each.groupBy("kind", "text", "side", "gram", "length").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")), "pii-edges", most, 64)


def counted(supported: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(gram, all): occurrences in the corpus of the patterns ``supported`` (gram, length).  Written."""
    n = supported.count()
    ends = supported.select("length", F.substring_index("gram", " ", -1).alias("word")).distinct().limit(ENDINGS + 1).collect()
    lengths = [r.length for r in supported.select("length").distinct().collect()]  # GRAM at most
    w = F.col("w")

    def ending(length: int) -> Column:
        """Runs of so many words that end as a pattern does."""
        words = [r.word for r in ends if r.length == length]
        if length == 1:
            return F.filter(w, lambda x: x.isin(*words))
        last = F.filter(F.sequence(F.lit(length), F.size(w)), lambda i: F.element_at(w, i).isin(*words))
        return F.when(F.size(w) >= length, F.transform(last, lambda i: F.array_join(F.slice(w, i - (length - 1), F.lit(length)), " ")))

    runs = [ending(k) if len(ends) <= ENDINGS else _grams(w, k) for k in lengths]
    words = docs.select(_words(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("w"))
    none = F.array().cast("array<string>")
    found = words.select(F.explode(F.concat(none, *(F.coalesce(x, none) for x in runs))).alias("gram"))
    count = F.count(F.lit(1)).alias("all")
    if n <= SENT:
        found = found.join(F.broadcast(supported.select("gram")), "gram", "left_semi").groupBy("gram").agg(count)
    else:  # summed and written first; else the optimiser moves the join below the sum, which shuffles every word
        found = materialise(found.groupBy("gram").agg(count), "pii-sums").join(supported.select("gram").hint("merge"), "gram", "left_semi")
    return materialise(found, "pii-words")


def discovered(tokens: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, text) of unknown tokens that the bootstrapping accepts.  Written."""
    spark = tokens.sparkSession
    graph = edges(tokens)
    # Only what stands beside enough tokens can become a pattern and needs corpus counts.
    enough = graph.groupBy("side", "gram", "length", "kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("instances")).where((F.col("n") >= SUPPORT) & (F.col("instances") >= INSTANCES))
    most = graph.count()
    supported = materialise(enough.select("gram", "length").distinct(), "pii-supported", most)
    counts = counted(supported, docs, text)
    some = materialise(graph.join(counts.hint("merge"), "gram"), "pii-graph", most, 64)
    seeds = graph.where("seed").select("kind", "text").distinct()
    known, accepted, rounds = seeds, spark.createDataFrame([], "kind string, text string"), []
    while True:  # what is accepted stays: more known identifiers never lower a score, and every round but the last one adds some
        held = some.join(known, ["kind", "text"], "left_semi").groupBy("side", "gram", "kind", "all").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("instances"))
        patterns = held.where((F.col("hits") >= SUPPORT) & (F.col("instances") >= INSTANCES)).select("side", "gram", "kind", F.least(F.col("hits") / F.col("all"), F.lit(0.999)).alias("confidence"))
        patterns = patterns.where(F.col("confidence") >= CONFIDENCE)
        # Instances of base spans stay known; others are known by their patterns of this round.
        sides = some.where("NOT seed").join(patterns, ["side", "gram", "kind"]).groupBy("kind", "text", "side").agg(F.max("confidence").alias("confidence"))
        scored = sides.groupBy("kind", "text").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        new = materialise(scored.where(F.col("score") >= ACCEPT).select("kind", "text").join(accepted, ["kind", "text"], "left_anti"), "pii-accepted", most)
        rounds.append(new)
        if not new.limit(1).count():
            break
        accepted = accepted.union(new)
        known = seeds.union(accepted)
    out = materialise(accepted, "pii-discovered", most)
    discard(graph, supported, counts, some, *rounds)
    return out


_NONE = "cast(array() as array<struct<rank:int,start:int,end:int>>)"


def spans(docs: DataFrame, keep: list[str], text: str = "text") -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The rows of docs without any match and those with, both with columns ``keep``, base and spans: arrays of (rank of kind,
    start, end) in order.  Last the written tables that both read."""
    rows, found = scanned(docs, keep, text)
    new = discovered(found, docs, text)
    accepted = new.withColumn("accepted", F.lit(True))
    rank = (F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1).cast("int")
    span = F.struct(rank.alias("rank"), "start", "end")
    known = found.join(accepted, ["kind", "text"], "left").where("base OR accepted")
    by_row = known.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
    kept, none = [F.col(f"`{c}`") for c in keep], F.expr(_NONE)
    plain = rows.where("NOT matched").select(*kept, none.alias("base"), none.alias("spans"))
    matched = rows.where("matched").join(by_row.hint("merge"), "row", "left").select(*kept, F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))
    return plain, matched, [rows, found, new]


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest and all spans of every document."""
    n = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    plain, matched, read = spans(docs, ["doc_id"])
    out = plain.union(matched).select("doc_id", *map(n, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
    out = materialise(out, "pii-report")
    discard(*read)
    return out


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of a text replaced by its kind in brackets; overlapping spans become one of the first's kind."""
    frame, name, columns = hidden(docs)
    plain, matched, _ = spans(frame, frame.columns, name)
    text = F.col(name)

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"))))
    clean = F.aggregate(by_place, F.expr("cast(struct(0, '') as struct<at:int,out:string>)"), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    matched = matched.withColumn(name, F.when(F.size("spans") == 0, text).otherwise(clean))
    return plain.union(matched).select(*columns)
