"""Secrets by pattern and by a battery of randomness tests, in DataFrame and SQL functions only.

Base kinds are assign (a name such as password or token and a value of six or more characters), access (AKIA keys) and
hex (runs of 24 or more hexadecimal digits). The method adds the kind random: runs of 20 or more characters of an
encoding's alphabet that hold letters or digits. For each, the encoding is inferred (hex, upper-case base 36,
lower-case base 36, base 64; without digits upper-case, lower-case or all letters, or base 64 without digits; digits alone, or
digits with signs), and three kinds of tests are made twice: alphabet uniformity by squared symbol counts, runs, and
lag-one serial correlation.

* Against uniform noise in that alphabet: what they reject at level ``NOISE_LEVEL`` is no random string.
* Against ordinary text: written words have favoured letters, few changes between letters and digits or from small to
  capital letters, and vowels that alternate with consonants. Where letters stand alone, which letters are favoured is asked as
  well: their likelihood under the letter frequencies of European languages. The one-sided p-values of the tests that can
  speak are combined by Fisher's rule, and this is the null hypothesis that false discovery counts: within each class of encoding and
  length (short candidates have little power, so they are judged among their like) the Benjamini-Hochberg rule at level ``fdr``
  picks those that are not ordinary text. Of them the ones that could be noise are reported. Runs of digits (and signs) are no words
  at all: the tests against noise alone decide on them, at level ``DIGIT_LEVEL``.

Where equals signs stand inside a run, what follows the first and each side of 20 or more characters are tested, and the
run is reported once if any of them is found. The rule runs on a histogram of logarithms of p-values, whose size doesn't
grow with the data. Work on a text grows with its length to the power 1.5 at most, however many matches it holds.

Offsets count code points, ends exclusive. Spans are found by marking matches with a private-use character that is
first replaced in the text by its neighbour, which no pattern tells from it.

Defined cases: a null or empty text has no spans; texts are read whole; repeated rows give repeated results; an empty
table gives an empty result; other columns are ignored (the operator reads and returns its own).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import as_documents, stage

#: Fixed patterns. Greedy runs make the length bounds of access and hex the same inside or outside the pattern; that of
#: assign is tested on the match, since a failing match is passed over as a whole.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
MARK, NEIGHBOUR = "", ""
#: Bins of p-values for each power of ten, and their number.
BINS_A_POWER, BINS, MIN_RANDOM, NOISE_LEVEL = 50, 1500, 20, 1e-4
#: No p-value above ``fdr`` is a discovery, so candidates above this are not put to the tests against noise.
WORTH = 0.25
#: Ordinary text: the chance that two, and three, of its letters (case folded) or digits are the same; the share of places where a
#: letter and a digit meet or a capital follows a small letter; the serial correlation of vowels, with room to spare.
SAME_LETTERS, CHANGES, VOWELS_SERIAL = (0.065, 0.0055), 0.2, -0.25
#: Parts of the letters a to z in running English, French, German and Spanish, rounded, in thousandths; how much more their
#: likelihood varies in written words than in letters drawn alone.
LETTERS, LETTER_SPREAD = (89, 15, 32, 44, 149, 14, 18, 31, 72, 5, 6, 46, 27, 76, 59, 22, 7, 67, 72, 70, 48, 12, 11, 3, 9, 6), 2.0
#: At this level the tests against noise pick the runs of digits that are no random number.
DIGIT_LEVEL = 0.01

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/",
    "upper letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower letters": "abcdefghijklmnopqrstuvwxyz",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "letters and signs": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/",
    "digits": "0123456789",
    "digits and signs": "0123456789+/",
}


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at the matches: pieces at even places are matches (places from 1)."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: Column expressions have no variables but a lambda's."""
    return F.transform(F.array(value), body)[0]


def blocks(values: Column) -> Column:
    """An array cut into about as many slices as each of them has elements."""
    size = F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int")
    return F.when(F.size(values) > 0, let(size, lambda b: F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / b).cast("int")), lambda k: F.slice(values, k * b + 1, b)))).otherwise(F.array())


def _before(values: Column, join) -> Column:
    """For each element of a short array what ``join`` makes of those before it, from 0."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, start, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def starts(lengths: Column) -> Column:
    """Running sums of lengths, each without its own: inside slices, and over the slices' totals."""
    def add(a: Column, x: Column) -> Column:
        return a + x

    def sums(cut: Column) -> Column:
        totals = F.transform(cut, lambda part: F.aggregate(part, F.lit(0).cast("long"), add))
        return F.flatten(F.zip_with(_before(totals, add), F.transform(cut, lambda part: _before(part, add)), lambda base, inner: F.transform(inner, lambda x: base + x)))

    return let(blocks(lengths), sums)


MATCHES = "array<struct<start:bigint,end:bigint,match:string>>"


def matches(text: Column, pattern: str, keep) -> Column:
    """array of (start, end, match) for the matches that ``keep`` accepts; texts without one are not cut."""

    def found(x: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(x["pieces"]) - 2, F.lit(2))
        each = F.transform(places, lambda k: F.struct(F.get(x["starts"], k).alias("start"), F.get(x["starts"], k + 1).alias("end"), F.get(x["pieces"], k).alias("match")))
        return F.filter(each, lambda m: keep(m["match"]))

    cut = let(pieces(text, pattern), lambda p: F.struct(p.alias("pieces"), starts(F.transform(p, lambda x: F.char_length(x).cast("long"))).alias("starts")))
    return F.when(F.rlike(text, F.lit(pattern)), let(cut, found)).otherwise(F.array()).cast(MATCHES)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by a rational approximation of the complementary error function (error < 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    tail = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _squares(values: Column, n: Column) -> Column:
    """Sum of the squared numbers of equal values."""
    return F.aggregate(F.array_distinct(values), F.lit(0.0), lambda a, d: a + let(n - F.size(F.array_remove(values, d)), lambda c: c * c))


def _chi_squared(codes: Column, n: Column, k: Column) -> Column:
    squares = _squares(codes, n)
    spread = 2 / (9 * (k - 1))
    return let((F.pow(F.greatest(squares * k / n - n, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread), normal_tail)


def _runs(codes: Column, n: Column, k: Column) -> Column:
    signs = F.transform(codes, lambda c: F.when(c >= k / 2, F.lit(1.0)).otherwise(F.lit(0.0)))

    def test(x: Column) -> Column:
        variance = (x["expected"] - 1) * (x["expected"] - 2) / (n - 1)
        return F.when(variance > 0, 2 * let(F.abs(x["runs"] - x["expected"]) / F.sqrt(variance), normal_tail)).otherwise(F.lit(0.0))

    def counts(s: Column) -> Column:
        changes = _total(F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: F.abs(a - b)))
        return let(F.struct((changes + 1).alias("runs"), let(_total(s), lambda high: 2 * high * (n - high) / n + 1).alias("expected")), test)

    return let(signs, counts)


def _serial(codes: Column, n: Column) -> Column:
    def test(d: Column) -> Column:
        power = _total(F.transform(d, lambda x: x * x))
        lagged = _total(F.zip_with(F.slice(d, F.lit(1), F.size(d) - 1), F.slice(d, F.lit(2), F.size(d) - 1), lambda a, b: a * b))
        return let(power, lambda v: F.when(v > 0, 2 * let(F.abs(lagged / v + 1 / n) * F.sqrt(n), normal_tail)).otherwise(F.lit(0.0)))

    return let(let(_total(codes) / n, lambda mean: F.transform(codes, lambda c: c - mean)), test)


def p_value(token: Column, alphabet: Column) -> Column:
    """Bonferroni over the three tests of the hypothesis that the token is uniform noise over the alphabet."""

    def battery(x: Column) -> Column:
        codes, n, k = x["codes"], x["n"], x["k"]
        return F.least(F.lit(1.0), 3 * F.least(_chi_squared(codes, n, k), _runs(codes, n, k), _serial(codes, n)))

    codes = let(alphabet, lambda letters: F.transform(F.regexp_extract_all(token, F.lit("(.)"), F.lit(1)), lambda c: (F.instr(letters, c) - 1).cast("double")))
    return let(F.struct(codes.alias("codes"), F.char_length(token).cast("double").alias("n"), F.char_length(alphabet).cast("double").alias("k")), battery)


def _small(x: Column) -> Column:
    return F.greatest(F.lit(1e-30), F.least(F.lit(1.0), x))


def _lower_tail(count: Column, mean: Column, variance: Column) -> Column:
    return F.when(variance > 0, let((mean - count) / F.sqrt(variance), normal_tail)).otherwise(F.lit(1.0))


def ordinary_p(token: Column) -> Column:
    """Fisher's combination of up to three one-sided tests of the hypothesis that the token is ordinary text; 0 for digits alone."""
    same2, same3 = SAME_LETTERS
    logs = [math.log(x / sum(LETTERS)) for x in LETTERS]
    mean = sum(x * y for x, y in zip(LETTERS, logs, strict=True)) / sum(LETTERS)
    spread = LETTER_SPREAD * (sum(x * y * y for x, y in zip(LETTERS, logs, strict=True)) / sum(LETTERS) - mean * mean)
    with_digits, with_letters = F.rlike(token, F.lit("[0-9]")), F.rlike(token, F.lit("[A-Za-z]"))
    one_case = ~F.rlike(token, F.lit("[a-z]")) | ~F.rlike(token, F.lit("[A-Z]"))

    def flat(chars: Column, n: Column) -> Column:
        """Fewer equal pairs of characters than favoured letters would make."""
        pairs = _squares(chars, n) - n
        variance = 4 * n * (n - 1) * (n - 2) * (same3 - same2 * same2) + 2 * n * (n - 1) * (same2 - same2 * same2)
        return _lower_tail(pairs, n * (n - 1) * same2, variance)

    def likely(folded: Column) -> Column:
        """Letters less likely than those of words."""
        table = F.array(*map(F.lit, logs))
        found = F.transform(F.filter(folded, lambda c: c.between("a", "z")), lambda c: F.get(table, F.ascii(c) - ord("a")))
        return let(found, lambda f: _lower_tail(_total(f), F.size(f) * mean, F.size(f) * spread))

    def neighbours(values: Column, join) -> Column:
        return F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values) - 1), join)

    def restless(kinds: Column, n: Column) -> Column:
        """More runs of like characters than words have. Kinds: 0 signs, 1 digits, 2 small letters, 3 capitals."""
        changes = _total(neighbours(kinds, lambda a, b: F.when(((a == 1) & (b > 1)) | ((a > 1) & (b == 1)) | ((a == 2) & (b == 3)), F.lit(1.0)).otherwise(F.lit(0.0))))
        return _lower_tail((n - 1) * 2 * CHANGES - changes + 0.5, (n - 1) * CHANGES, (n - 1) * CHANGES * (1 - CHANGES))

    def serial(vowels: Column, n: Column) -> Column:
        """Vowels that don't alternate with other letters."""
        def test(d: Column) -> Column:
            power, lagged = _total(F.transform(d, lambda x: x * x)), _total(neighbours(d, lambda a, b: a * b))
            return let(power, lambda v: F.when(v > 0, let((lagged / v - VOWELS_SERIAL) * F.sqrt(n), normal_tail)).otherwise(F.lit(1.0)))

        return let(let(_total(vowels) / n, lambda mean: F.transform(vowels, lambda c: c - mean)), test)

    def combined(x: Column) -> Column:
        two = -(F.log(_small(x["a"])) + F.log(_small(x["c"])))
        # In letters of one case no change of kind is possible.
        return F.when(x["b"].isNull(), let(two, lambda h: F.exp(-h) * (1 + h))).otherwise(let(two - F.log(_small(x["b"])), lambda h: F.exp(-h) * (1 + h + h * h / 2)))

    def tests(x: Column) -> Column:
        chars, n = x["chars"], F.size(x["chars"]).cast("double")
        folded = F.transform(chars, F.lower)
        kinds = F.transform(chars, lambda c: F.when(c.between("0", "9"), 1).when(c.between("a", "z"), 2).when(c.between("A", "Z"), 3).otherwise(0))
        vowels = F.transform(folded, lambda c: F.when(F.instr(F.lit("aeiouy"), c) > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        return let(F.struct(let(folded, lambda f: F.when(with_digits, flat(f, n)).otherwise(likely(f))).alias("a"), F.when(with_digits | ~one_case, let(kinds, lambda k: restless(k, n))).alias("b"), let(vowels, lambda v: serial(v, n)).alias("c")), combined)

    return F.when(with_letters, let(F.struct(F.regexp_extract_all(token, F.lit("(.)"), F.lit(1)).alias("chars")), tests)).otherwise(F.lit(0.0))


def encoding(token: Column) -> Column:
    """The narrowest alphabet that holds the token; null where it has neither letters nor digits.

    Tokens without digits or without letters have classes of their own, so that they don't move the limits of the others.
    """
    def holds(pattern: str) -> Column:
        return F.rlike(token, F.lit(pattern))

    both = F.when(holds("^[0-9a-f]+$"), "hex").when(holds("^[0-9A-Z]+$"), "upper").when(holds("^[0-9a-z]+$"), "lower").otherwise("base64")
    letters = F.when(holds("^[A-Z]+$"), "upper letters").when(holds("^[a-z]+$"), "lower letters").when(holds("^[A-Za-z]+$"), "letters").otherwise("letters and signs")
    digits = F.when(holds("^[0-9]+$"), "digits").otherwise("digits and signs")
    return F.when(holds("[0-9]") & holds("[A-Za-z]"), both).when(holds("[A-Za-z]"), letters).when(holds("[0-9]"), digits)


def _alphabet(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in ALPHABETS.items() for x in pair)), kind)


def _numbered(found: Column, kind: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))).cast(SPAN)


def located(text: Column) -> list[Column]:
    """Base spans of each kind and the randomness candidates of a text, as columns."""
    safe = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, NEIGHBOUR)).otherwise(text)
    base = [
        ("assign", matches(safe, ASSIGN, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6)),
        ("access", matches(safe, ACCESS, lambda m: F.lit(True))),
        ("hex", matches(safe, HEX, lambda m: F.lit(True))),
    ]
    columns = [_numbered(found, k).alias(kind) for k, (kind, found) in enumerate(base)]

    def judged(s: Column, token: Column) -> Column:
        tested = F.char_length(token) >= MIN_RANDOM
        return let(encoding(token), lambda code: F.struct(s["start"].alias("start"), s["end"].alias("end"), code.alias("encoding"), F.char_length(token).alias("length"), token.alias("token"), F.when(code.isNotNull() & tested, ordinary_p(token)).alias("p")))

    def tested(s: Column) -> Column:
        # A name, an equals sign or padding around the token is not part of what is tested; each side of one inside is, too.
        bare = F.regexp_replace(s["match"], "^[^=]*=(?=[A-Za-z0-9])|=+$", "")
        sides = F.filter(F.array_distinct(F.concat(F.array(bare), F.split(s["match"], "=+"))), lambda side: F.char_length(side) >= MIN_RANDOM)
        return F.transform(sides, lambda side: let(F.regexp_replace(side, "[-_=]", "+"), lambda token: judged(s, token)))

    def against_noise(c: Column) -> Column:
        noise = F.when(c["p"] <= WORTH, p_value(c["token"], _alphabet(c["encoding"])))
        return F.struct(*(c[x].alias(x) for x in ("start", "end", "encoding", "length", "p")), noise.alias("noise"))

    first = F.filter(F.flatten(F.transform(matches(safe, CANDIDATE, lambda m: F.lit(True)), tested)), lambda c: c["p"].isNotNull())
    candidates = F.transform(first, against_noise)
    return [*columns, candidates.alias("candidates")]


def length_class(length: Column) -> Column:
    """Classes of candidates with like power: lengths by powers of two, all above 512 together."""
    return F.least(F.floor(F.log2(length.cast("double"))), F.lit(9)).cast("int")


def p_bin(p: Column) -> Column:
    """Number of the bin: 0 for p near 1, each bin's upper bound is 10^(-bin / BINS_A_POWER)."""
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * BINS_A_POWER), F.lit(BINS - 1)).cast("int")


def discovery_limits(found: DataFrame, fdr: float) -> dict[tuple[str, int], int]:
    """For each class the lowest bin whose candidates Benjamini-Hochberg takes for other than ordinary text, BINS for none.

    At most 10 encodings x 10 length classes x 1500 bins are aggregated, whatever the size of the corpus.
    """
    if fdr > WORTH:
        raise ValueError(f"fdr must be at most {WORTH}")
    each = found.select(F.explode("candidates").alias("c")).select(F.col("c.encoding").alias("encoding"), length_class(F.col("c.length")).alias("class"), p_bin(F.col("c.p")).alias("bin"))
    counts = each.groupBy("encoding", "class", "bin").agg(F.count("*").alias("n"))
    own = Window.partitionBy("encoding", "class")
    ranked = counts.select("encoding", "class", "bin", F.sum("n").over(own).alias("total"), F.sum("n").over(own.orderBy(F.col("bin").desc())).alias("beyond"))
    passing = F.pow(F.lit(10.0), -F.col("bin") / BINS_A_POWER) * F.col("total") <= fdr * F.col("beyond")
    limits = ranked.groupBy("encoding", "class").agg(F.coalesce(F.min(F.when(passing, F.col("bin"))), F.lit(BINS)).alias("limit")).collect()
    return {(r["encoding"], r["class"]): r["limit"] for r in limits}


def random_spans(limits: dict[tuple[str, int], int]) -> Column:
    """The candidates that are beyond their class's limit for ordinary text and could be noise."""
    table = F.create_map(*(F.lit(x) for (code, size), limit in limits.items() for x in (f"{code}/{size}", limit))) if limits else F.create_map(F.lit(""), F.lit(BINS))

    def secret(c: Column) -> Column:
        key = F.concat(c["encoding"], F.lit("/"), length_class(c["length"]).cast("string"))
        level = F.when(c["encoding"].startswith("digits"), F.lit(DIGIT_LEVEL)).otherwise(F.lit(NOISE_LEVEL))
        return (c["noise"] >= level) & (p_bin(c["p"]) >= F.coalesce(F.try_element_at(table, key), F.lit(BINS)))

    return F.array_distinct(_numbered(F.filter("candidates", secret), 3))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined; the spans are sorted by start, then kind."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    texts = as_documents(docs)
    found = stage(texts.select("doc_id", *located(F.col("text"))), "secret-candidates")
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.concat(base, random_spans(discovery_limits(found, fdr)))).alias("spans"),
    )


def _replaced(text: Column, spans: Column, mark: str) -> Column:
    """The text with ``mark`` for each span of a sorted array; spans that overlap become one.

    The spans are taken in slices. The text is cut at the slices' ends first and at the spans inside these short pieces
    then, since finding a place in a text takes a walk from its beginning.
    """
    empty = F.array().cast("array<string>")

    def inside(part: Column, base: Column, piece: Column) -> Column:
        start = F.struct(base.alias("at"), empty.alias("out"))

        def step(acc: Column, s: Column) -> Column:
            kept = F.substring(piece, (acc["at"] - base + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
            return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(kept, F.lit(mark))).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

        return F.aggregate(part, start, step, lambda acc: F.array_join(acc["out"], ""))

    def whole(x: Column) -> Column:
        def one(part: Column, base: Column) -> Column:
            end = F.greatest(base, F.array_max(F.transform(part, lambda s: s["end"])))
            return let(F.substring(text, (base + 1).cast("int"), (end - base).cast("int")), lambda piece: inside(part, base, piece))

        done = F.zip_with(x["parts"], x["bases"], one)
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(done, ""), F.substring(text, (last + 1).cast("int"), F.char_length(text)))

    def bases(parts: Column) -> Column:
        return _before(F.transform(parts, lambda part: F.array_max(F.transform(part, lambda s: s["end"]))), F.greatest)

    return F.when(F.size(spans) == 0, text).otherwise(let(let(blocks(spans), lambda p: F.struct(p.alias("parts"), bases(p).alias("bases"))), whole))


def redact(docs: DataFrame, text_col: str = "text", fdr: float = 0.05, with_: str = "[SECRET]") -> DataFrame:
    """All columns of ``docs``, each secret in the text replaced; overlapping spans become one, a null text stays.

    Texts are searched once; what is found is staged beside the rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    assign, access, hexes, candidates = located(text)
    found = stage(docs.select(F.struct(*docs.columns).alias("row"), F.concat(assign, access, hexes).alias("base"), candidates), "secret-candidates")
    spans = F.array_sort(F.concat("base", random_spans(discovery_limits(found, fdr))))
    cleaned = _replaced(F.col("row")[text_col], F.col("spans"), with_)
    return found.select("row", spans.alias("spans")).select(*(cleaned.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
