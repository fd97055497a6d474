"""Secret scans in DataFrame functions only: fixed patterns and a randomness test battery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")

#: Fixed patterns of the base kinds. Only ``assign`` has a group, and needs its length checked
#: after matching, as a failing match still uses up its text.
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Candidates of the battery: runs of key letters of at least so many characters.
LEAST = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Encodings by the first pattern that fits, and the alphabet of each; fixed values.
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("hex", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("letters", r"^[A-Za-z]?[a-z]+$|^[A-Z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", r"^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^[A-Za-z0-9_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Upper bounds of the length classes within which false discoveries are controlled.
CLASSES = (24, 32, 48, 96)
#: Ordinary words: runs of letters too short for a candidate that are no part of a longer run of key letters.
PLAIN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z]{{1,{LEAST - 1}}}+(?![A-Za-z0-9+/_=-])"
#: Steps of the -log10 of the combined p-value in the histograms, and the largest step.
STEP, STEPS = 0.05, 400


#: What takes the place of a secret.
MARK = "[SECRET]"


def located(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap: array of (start, end, word) in code points.

    The text between matches and the matches themselves, laid end to end, give the places.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(hits)), hits,
        lambda g, h: F.struct(F.char_length(g).alias("g"), F.char_length(h).alias("h"), h.alias("w")),
    )
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,word:string>>").alias("out"))
    walked = F.aggregate(both, empty, lambda acc, x: F.struct(
        (acc["at"] + x["g"] + x["h"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["h"]).alias("end"), x["w"].alias("word"),
        ))).alias("out"),
    ))
    return walked["out"]


def spans(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["word"].alias("word")))


SPANS = "array<struct<start:int,end:int,kind:string,word:string>>"


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind in a text without nulls."""
    none = F.array().cast(SPANS)
    plain = F.lower(text)
    asked = plain.contains(KEYWORDS[0])
    for word in KEYWORDS[1:]:
        asked = asked | plain.contains(word)
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.filter(
        F.zip_with(located(text, ASSIGN), value, lambda x, v: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["word"].alias("word"), F.char_length(v).alias("n"))),
        lambda x: x["n"] >= 12,
    )
    return {
        "assign": F.when(asked & text.rlike(ASSIGN), spans("assign", assign)).otherwise(none),
        "access": F.when(text.contains("AKIA"), spans("access", located(text, ACCESS))).otherwise(none),
        "hex": F.when(text.rlike(HEX), spans("hex", located(text, HEX))).otherwise(none),
    }


def upper_tail(z: Column) -> Column:
    """Normal tail probability by the logistic approximation."""
    return 1 / (1 + F.exp(F.lit(1.5976) * z + F.lit(0.070566) * z * z * z))


def battery(found: Column, plain: bool = False) -> Column:
    """Randomness tests of each candidate (start, end, word) for its inferred encoding.

    Adds encoding, class (of length) and step, the -log10 of the combined p-value in steps: 0 for
    a string that looks drawn evenly from its alphabet, larger the less it does. The tests are
    chi-squared over the alphabet (Wilson-Hilferty), runs about the alphabet's middle, and lag-one
    serial correlation; their p-values are combined by Fisher's method. ``plain`` is for words of small
    letters only, whose sums string functions give at less cost.
    """
    def encode(x: Column) -> Column:
        word = x["word"]
        kind, letters = F.lit("base64"), F.lit(ENCODINGS[-1][2])
        for name, pattern, alphabet in reversed(ENCODINGS[:-1]):
            fits = word.rlike(pattern)
            kind, letters = F.when(fits, F.lit(name)).otherwise(kind), F.when(fits, F.lit(alphabet)).otherwise(letters)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), word.alias("word"), kind.alias("encoding"), letters.alias("letters"))

    def digits(x: Column) -> Column:
        body = F.regexp_replace(x["word"], F.lit("=+$"), F.lit(""))
        body = F.when(x["encoding"] == "letters", F.lower(body)).otherwise(body)
        places = F.transform(F.split(body, ""), lambda c: F.greatest(F.instr(x["letters"], c) - 1, F.lit(0)))
        return F.struct(*[x[c].alias(c) for c in ("start", "end", "word", "encoding")],
                        F.char_length(x["letters"]).cast("double").alias("a"), places.alias("v"))

    def sums(x: Column) -> Column:
        v, a = x["v"], x["a"]
        n = F.size(v).cast("double")
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.size(F.array_remove(v, c)), F.lit(2.0)))
        high = F.size(F.filter(v, lambda c: c >= a / 2)).cast("double")
        pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        turns = F.size(F.filter(pairs, lambda t: (t["p"] >= a / 2) != (t["q"] >= a / 2))).cast("double")
        total = F.aggregate(v, F.lit(0.0), lambda acc, c: acc + c)
        power = F.aggregate(v, F.lit(0.0), lambda acc, c: acc + c * c)
        cross = F.aggregate(pairs, F.lit(0.0), lambda acc, t: acc + t["p"] * t["q"])
        ends = F.element_at(v, 1) * F.element_at(v, -1)
        return F.struct(*[x[c].alias(c) for c in ("start", "end", "word", "encoding", "a")],
                        n.alias("n"), squares.alias("squares"), high.alias("high"), turns.alias("turns"),
                        total.alias("total"), power.alias("power"), (cross + ends).alias("cross"))

    def counted(x: Column) -> Column:
        word, letters = x["word"], ENCODINGS[2][2]
        n = F.char_length(word)
        half = F.translate(word, letters, "0" * 13 + "1" * 13)
        turns = sum((n - F.char_length(F.replace(half, F.lit(t), F.lit("")))) / 2 for t in ("01", "10"))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), word.alias("word"), n.cast("double").alias("n"),
                        F.array(*[(n - F.char_length(F.replace(word, F.lit(c), F.lit("")))).cast("double") for c in letters]).alias("c"),
                        turns.alias("turns"), F.transform(F.split(word, ""), lambda c: (F.ascii(c) - 97).cast("double")).alias("v"))

    def letter_sums(x: Column) -> Column:
        c, v = [x["c"][i] for i in range(26)], x["v"]
        cross = F.aggregate(F.sequence(F.lit(0), F.size(v) - 2), F.lit(0.0), lambda acc, i: acc + F.get(v, i) * F.get(v, i + 1))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["word"].alias("word"), F.lit("letters").alias("encoding"),
                        F.lit(26.0).alias("a"), x["n"].alias("n"), sum(k * k for k in c).alias("squares"),
                        sum(c[13:]).alias("high"), x["turns"].alias("turns"), sum(i * k for i, k in enumerate(c)).alias("total"),
                        sum(i * i * k for i, k in enumerate(c)).alias("power"),
                        (cross + F.element_at(v, 1) * F.element_at(v, -1)).alias("cross"))

    # Several stages, as an expression that is used again inside a lambda is evaluated again.
    def parts(x: Column) -> Column:
        n, a = x["n"], x["a"]
        even = 2 * x["high"] * (n - x["high"])
        vary = x["power"] - x["total"] * x["total"] / n
        return F.struct(*[x[c].alias(c) for c in ("start", "end", "word", "encoding", "n", "high", "turns")],
                        (F.lit(2 / 9) / (a - 1)).alias("u"), even.alias("even"), vary.alias("vary"),
                        F.pow(F.greatest(a / n * x["squares"] - n, F.lit(1e-9)) / (a - 1), F.lit(1 / 3)).alias("root"),
                        (x["cross"] - x["total"] * x["total"] / n).alias("joint"))

    def scores(x: Column) -> Column:
        n, even = x["n"], x["even"]
        z_chi = (x["root"] - (1 - x["u"])) / F.sqrt(x["u"])
        spread = F.sqrt(F.greatest(even * (even - n) / (n * n * (n - 1)), F.lit(1e-9)))
        z_runs = F.when((x["high"] > 0) & (x["high"] < n), F.abs(x["turns"] - even / n) / spread).otherwise(F.sqrt(n))
        serial = F.when(x["vary"] > 0, x["joint"] / x["vary"]).otherwise(F.lit(1.0))
        z_serial = F.abs(serial + 1 / n) * F.sqrt(n)
        return F.struct(*[x[c].alias(c) for c in ("start", "end", "word", "encoding")],
                        F.array(*[F.least(z, F.lit(12.0)) for z in (z_chi, z_runs, z_serial)]).alias("z"))

    def fisher(x: Column) -> Column:
        # One-sided for chi-squared, two-sided for the others.
        tails = F.transform(x["z"], lambda z, i: F.when(i == 0, upper_tail(z)).otherwise(F.least(2 * upper_tail(z), F.lit(1.0))))
        half = F.aggregate(tails, F.lit(0.0), lambda acc, t: acc - F.log(F.greatest(t, F.lit(1e-30))))
        return F.struct(*[x[c].alias(c) for c in ("start", "end", "word", "encoding")], half.alias("half"))

    def stepped(x: Column) -> Column:
        half = x["half"]
        tail = (half - F.log(1 + half + half * half / 2)) / F.lit(2.302585092994046)
        step = F.least(F.floor(F.greatest(tail, F.lit(0.0)) / STEP), F.lit(STEPS)).cast("int")
        return F.struct(*[x[c].alias(c) for c in ("start", "end", "word", "encoding")], step.alias("step"))

    def classed(x: Column) -> Column:
        size, k = x["end"] - x["start"], F.lit(len(CLASSES))
        for i in reversed(range(len(CLASSES))):
            k = F.when(size <= CLASSES[i], F.lit(i)).otherwise(k)
        return F.struct(*[x[c].alias(c) for c in ("start", "end", "word", "encoding", "step")], k.alias("class"))

    for stage in (*((counted, letter_sums) if plain else (encode, digits, sums)), parts, scores, fisher, stepped, classed):
        found = F.transform(found, stage)
    return found


def candidates(text: Column) -> Column:
    none = F.array().cast("array<struct<start:int,end:int,word:string>>")
    return F.when(text.rlike(TOKEN), located(text, TOKEN)).otherwise(none)


def null_lengths(rounds: int = 16) -> list[int]:
    """Lengths at which joined words are cut: class by class in turn, spread over each class."""
    bounds = list(zip((LEAST, *(c + 1 for c in CLASSES)), (*CLASSES, 2 * CLASSES[-1])))
    return [low + (2 * i + 1) * (high - low + 1) // (2 * rounds) for i in range(rounds) for low, high in bounds]


def joined(text: Column) -> Column:
    """Letter strings of the lengths of every class, as (start, end, word): the null of the battery.

    The ordinary words of a text are joined, and cut without overlap, so that each letter is in one
    string at most; the rest that fills no length is left out. The class to begin with follows from
    the number of letters, so that short texts serve all classes up to their own length.
    """
    lengths = null_lengths()
    k, period = len(CLASSES) + 1, sum(lengths)

    def places(first: int) -> Column:
        turned = lengths[first:] + lengths[:first]
        return F.array(*[F.struct(F.lit(sum(turned[:i]) + 1).alias("at"), F.lit(n).alias("n")) for i, n in enumerate(turned)])

    letters = F.lower(F.array_join(F.regexp_extract_all(text, F.lit(PLAIN), F.lit(0)), ""))
    # Each struct binds what later steps use again, so that nothing runs once per part or string.
    whole = F.transform(F.array(letters), lambda w: F.struct(
        F.regexp_extract_all(w, F.lit(rf"[a-z]{{1,{period}}}"), F.lit(0)).alias("parts"), (F.char_length(w) % k + 1).alias("turn")))
    parts = F.flatten(F.transform(whole, lambda w: F.transform(w["parts"], lambda part: F.struct(
        part.alias("part"), F.char_length(part).alias("size"), w["turn"].alias("turn")))))
    turns = F.array(*[places(i) for i in range(k)])
    return F.flatten(F.transform(parts, lambda p: F.transform(
        F.filter(F.element_at(turns, p["turn"]), lambda t: t["at"] + t["n"] - 1 <= p["size"]),
        lambda t: F.struct(F.lit(0).alias("start"), t["n"].alias("end"), F.substring(p["part"], t["at"], t["n"]).alias("word")))))


def limits(docs: DataFrame, text: str = "text", rate: float = 0.05) -> dict[int, int]:
    """For each length class the largest step at which candidates are reported.

    Strings of letters alone show how often text of such length passes the tests by chance: words
    of that length, and neighbouring shorter words joined. The limit is the largest step at which
    the expected share of such strings among what is reported stays within ``rate``; each class has
    its own, as short strings pass more easily. Counts run over all documents; only a histogram of
    classes by steps reaches the driver. A class without letter strings, as where no text has words
    enough for its length, reports nothing.
    """
    body = F.coalesce(text, F.lit(""))
    found = F.explode(F.concat(battery(candidates(body)), battery(joined(body), plain=True))).alias("x")
    rows = docs.select(found).select("x.*").groupBy("class", "step").agg(
        F.count(F.when(F.col("encoding") == "letters", 1)).alias("plain"),
        F.count(F.when(F.col("encoding") != "letters", 1)).alias("other"),
    ).collect()
    out = {}
    for k in range(len(CLASSES) + 1):
        plain = {r.step: r.plain for r in rows if r["class"] == k}
        other = {r.step: r.other for r in rows if r["class"] == k}
        words, asked = sum(plain.values()), sum(other.values())
        passing, reported, best = 0, 0, -1
        for s in sorted({*plain, *other}):
            passing += plain.get(s, 0)
            reported += other.get(s, 0)
            if reported and (passing + 0.5) / (words + 1) * asked <= rate * reported:
                best = s
        out[k] = best
    return out


def scan(docs: DataFrame, text: str = "text", rate: float = 0.05) -> DataFrame:
    """Adds ``_base`` and ``_spans``: arrays of (start, end, kind, word), end exclusive, in code points.

    ``_base`` holds the fixed patterns, by start and then kind as listed in ``KINDS``. ``_spans``
    also has the battery's finds (kind ``random``) that touch no base span. A null text is empty.
    """
    allowed = limits(docs, text, rate)
    body = F.coalesce(F.col(text), F.lit(""))
    rank = F.create_map(*[y for i, k in enumerate((*KINDS, "random")) for y in (F.lit(k), F.lit(i))])
    found = base_spans(body)

    def ordered(array: Column) -> Column:
        keyed = F.transform(array, lambda x: F.struct(
            x["start"].alias("start"), rank[x["kind"]].alias("r"), x["end"].alias("end"), x["kind"].alias("kind"), x["word"].alias("word")))
        return F.transform(F.array_sort(keyed), lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["word"].alias("word")))

    marked = docs.withColumns({f"_{k}": found[k] for k in KINDS}).withColumn("_found", candidates(body))
    marked = marked.withColumn("_base", ordered(F.concat(*[F.col(f"_{k}") for k in KINDS])))
    step = F.create_map(*[y for k, s in allowed.items() for y in (F.lit(k), F.lit(s))])
    clear = F.filter("_found", lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    passed = F.filter(battery(clear), lambda x: (x["encoding"] != "letters") & (x["step"] <= step[x["class"]]))
    marked = marked.withColumn("_spans", ordered(F.concat(F.col("_base"), spans("random", passed))))
    return marked.drop("_found")


def listed(array: str) -> Column:
    return F.array_join(F.transform(array, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, text: str = "text", rate: float = 0.05) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans."""
    marked = scan(docs, text, rate)
    return marked.select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        (F.size("_spans") - F.size("_base")).cast("long").alias("n_random"),
        F.sha2(listed("_base").cast("binary"), 256).alias("base_sha256"), listed("_spans").alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = MARK, rate: float = 0.05) -> DataFrame:
    """``docs`` with every span found in ``text`` replaced by ``mark``; spans that meet become one."""
    marked = scan(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text")), "_text", rate)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        piece = F.when(fresh, F.concat(F.substring("_text", acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    walked = F.aggregate("_spans", state, step)
    clean = F.concat(walked["out"], F.substring(F.col("_text"), walked["at"] + 1, F.char_length("_text")))
    new = F.when(F.size("_spans") > 0, clean).otherwise(F.col("_text"))
    return marked.select(*[new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
