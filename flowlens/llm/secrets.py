"""Secret scan: fixed credential patterns, and a Markov test that tells random strings from identifiers.

First-order character models are counted from labelled samples: one of ordinary identifiers, words, paths and numbers, and one for
each family of random strings. A token is a secret if, for some family, the largest sum of log-likelihood ratios over
any stretch of its character steps is high, so an ordinary prefix does not dilute what follows it. All of it is
column functions: each table of ratios (one entry for each pair of ASCII characters) is an array literal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.spans import SPAN, match_spans, merged, no_spans, replaced, running
from flowlens.llm.texts import ascii_lower, whole
from flowlens.plans.shared import let

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that are too short are left out here: a run that fails leaves none inside it that would pass.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: What may be a random string: runs of the base64 alphabets of at least so many characters.
TOKEN_CHARS, SHORTEST = "A-Za-z0-9+/_=-", 16
ALPHABET = 128
#: Ratios are whole multiples of 1 / UNITS, so that sums are exact; samples of each family and of identifiers.
UNITS, SAMPLES = 1000, 3000
#: Families of random strings, with the alphabets and lengths of their samples (- : hex in the groups of a UUID).
LOWER_HEX, LETTERS, DIGITS = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "0123456789"
FAMILIES = (
    ((LOWER_HEX, 40), ("-", 36)),
    ((LOWER_HEX.upper(), 40), (LETTERS.upper() + "234567", 32), (LETTERS.upper(), 32), (LETTERS.upper() + DIGITS, 32)),
    ((LETTERS, 32), (LETTERS + DIGITS, 32)),
    ((LETTERS + LETTERS.upper(), 40), (LETTERS + LETTERS.upper() + DIGITS, 40), (LETTERS + LETTERS.upper() + DIGITS + "+/", 44)),
)
#: What one step counts at most, so that no odd pair alone makes a secret.
MOST_STEP = 2500
#: Sums that make a secret, by family, in units: at most one in about 150 identifiers whose words are in no sample passes each.
THRESHOLDS = (10_000, 6500, 8300, 10_500)
#: Weight of what is known of kinds of characters (lower, upper, digit, other) against the pairs seen: of identifiers, of random strings.
BACKED, BACKED_RANDOM = 0.2, 0.05

#: Ordinary parts of identifiers and common words of four languages; samples join two to five of them.
PARTS = (
    "get set user name list item value index count total file path line text page data table row column key map node edge graph "
    "read write open close load save parse format print error warn debug info test check valid config option default version "
    "update create delete insert select order group join window time date day month year start end first last next previous "
    "client server request response header body status code message queue topic batch stream worker task job stage plan query "
    "source target input output buffer cache memory disk size length width height color image audio video event handler listener"
).split()
WORDS = (
    "the of and to that with have this from they would there their what about which when make like just know take people into good some could "
    "them other than then look only come over think also back after work well even because these give most between through something another "
    "against together without thought always under might while house world still great never should again place school system program question "
    "government number point company service problem international communication understanding responsibility administration characterization "
    "straightforward nevertheless acknowledgement neighborhood organization representative transformation infrastructure documentation "
    "configuration authentication implementation temperature knowledge verantwortung geschwindigkeit entwicklung gesellschaft wissenschaft "
    "moeglichkeiten freundschaft zusammen wirtschaft durchschnitt schwierigkeiten empfehlung pflicht einheit freiheit zwischen niemals vergleich "
    "herausforderung beziehungsweise selbstverstaendlich rechtsschutz strasse developpement gouvernement etablissement responsabilite "
    "particulierement environnement quelquechose aujourdhui nouveaux bateaux niveau beaucoup oiseau lieu heureux generaux travaux jeunesse "
    "faillir desarrollo responsabilidad administracion conocimiento caracteristicas informacion establecimiento trabajo ejemplo aunque llegar "
    "guerra mientras razon"
).split()


def _dealt(i: Column, of: str, n: int) -> Column:
    """A number below n for sample i, from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{of}-"), i.cast("string"))), 1, 8), 16, 10).cast("long") % n


def _drawn(digest: Column, alphabet: str, n: int) -> Column:
    """n characters of an alphabet, by the bytes of a digest in hexadecimal."""
    byte = lambda k: F.conv(F.substring(digest, k * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.substring(F.lit(alphabet), byte(k) % len(alphabet) + 1, F.lit(1))), "")


def _uuid(digest: Column) -> Column:
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def builtin_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(text, family): n random strings of each family, and n identifiers (family -1) in nine styles, the same each time."""
    i = F.col("id")
    digest = F.concat(*[F.sha2(F.concat(F.lit(f"{half}-"), i.cast("string")), 256) for half in "ab"])
    rows = spark.range(n)
    made = None
    for family, kinds in enumerate(FAMILIES):
        texts = F.array(*[_uuid(digest) if a == "-" else _drawn(digest, a, size) for a, size in kinds])
        one = rows.select(F.get(texts, (i % len(kinds)).cast("int")).alias("text"), F.lit(family).alias("family"))
        made = one if made is None else made.unionByName(one)
    words = F.split(F.lit(" ".join(PARTS + WORDS)), " ")
    chosen = F.slice(F.array(*[F.get(words, _dealt(i, f"part{k}", len(PARTS) + len(WORDS)).cast("int")) for k in range(5)]), F.lit(1), (F.floor(i / 9) % 4 + 2).cast("int"))
    joined = lambda sep, f: F.array_join(F.transform(F.col("w"), f), sep)
    same, first = (lambda p: p), F.get("w", F.lit(0))
    camel = F.concat(first, F.array_join(F.transform(F.slice("w", 2, 9), F.initcap), ""))
    digits = F.element_at(F.array(_drawn(digest, DIGITS, 19), F.concat_ws("-", *[F.substring(_drawn(digest, DIGITS, 32), a, b) for a, b in ((1, 2), (5, 5), (11, 8), (20, 3))]), F.concat(F.lit("20"), F.regexp_replace(F.substring(_drawn(digest, DIGITS, 32), 1, 12), "(..)(..)(..)(.*)", "$1-$2-$3T$4"))), (F.floor(i / 9) % 3 + 1).cast("int"))
    styles = F.array(joined("_", same), joined("-", same), joined("", F.initcap), joined("_", F.upper), joined("/", same), joined("", same), camel, F.concat(joined("/", same), F.lit("/"), first, F.lit("-"), F.get("w", F.lit(1))), digits)
    sep = F.element_at(F.create_map(*[F.lit(x) for pair in TAILS.items() for x in pair]), (i % 9).cast("int"))
    tail = F.when((_dealt(i, "numbered", 3) == 0) & sep.isNotNull(), F.concat(sep, _dealt(i, "number", 2030).cast("string"))).otherwise("")
    plain = rows.select("id", chosen.alias("w")).select(F.concat(F.get(styles, (i % 9).cast("int")), tail).alias("text"), F.lit(-1).alias("family"))
    return made.unionByName(plain)


#: Styles that may end in a number, and what comes before it.
TAILS = {0: "_", 1: "-", 3: "_", 4: "/", 7: "/"}


def _kind(c: int) -> int:
    return 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3


#: Characters of tokens by kind.
_KINDS_SIZE = (26, 26, 10, 5)


def step_chances(counts: dict[tuple[int, int], int], share: float):
    """Chance of a step from character a to b: pairs as counted, backed by how often kinds of characters follow each other."""
    own: dict[int, int] = {}
    kinds: dict[tuple[int, int], int] = {}
    for (a, b), n in counts.items():
        own[a] = own.get(a, 0) + n
        kinds[_kind(a), _kind(b)] = kinds.get((_kind(a), _kind(b)), 0) + n
    total = [sum(kinds.get((x, y), 0) for y in range(4)) for x in range(4)]

    def chance(a: int, b: int) -> float:
        backed = (kinds.get((_kind(a), _kind(b)), 0) + 0.5) / (total[_kind(a)] + 2.0) / _KINDS_SIZE[_kind(b)]
        weight = share * own.get(a, 0) + 1.0
        return (counts.get((a, b), 0) + weight * backed) / (own.get(a, 0) + weight)

    return chance


def train(samples: DataFrame) -> list[list[int]]:
    """For each family the log-likelihood ratios of character steps, random against ordinary, at place 128 * first + second, in
    units of 1 / UNITS.

    samples: rows (text string, family int, -1 for ordinary); nulls and characters beyond ASCII are passed over. Counts
    over all samples in one aggregation; at most 128 * 128 counts of each family reach the driver.
    """
    code = lambda t, i: F.ascii(F.substring(t, i, 1))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.struct(code(t, i).alias("a"), code(t, i + 1).alias("b")))
    steps = F.filter(let(F.col("text"), pairs), lambda s: (s["b"] > 0) & (s["a"] < ALPHABET) & (s["b"] < ALPHABET))
    rows = samples.where("text is not null and family is not null").select("family", F.explode(steps).alias("s")).groupBy("family", "s.a", "s.b").count().collect()
    of = lambda family: {(r["a"], r["b"]): r["count"] for r in rows if r["family"] == family}
    plain = step_chances(of(-1), BACKED)
    tables = []
    for family in sorted({r["family"] for r in rows} - {-1}):
        random = step_chances(of(family), BACKED_RANDOM)
        tables.append([min(MOST_STEP, math.floor(math.log(random(a, b) / plain(a, b)) * UNITS + 0.5)) for a in range(ALPHABET) for b in range(ALPHABET)])
    return tables


def best_stretch(token: Column, table: Column) -> Column:
    """Largest sum of ratios over a stretch of the steps of a token of ASCII characters, 0 for none, in units of 1 / UNITS."""

    def values(data: Column) -> Column:
        at = lambda i: F.ascii(F.substring(data, i, F.lit(1)).cast("string"))
        return F.transform(F.sequence(F.lit(1), F.octet_length(data) - 1), lambda i: F.coalesce(F.get(table, at(i) * ALPHABET + at(i + 1)), F.lit(0)))

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("now"), zero.alias("best"))
    more = lambda a, v: F.greatest(a["now"] + v, zero)
    total = lambda data: F.aggregate(values(data), start, lambda a, v: F.struct(more(a, v).alias("now"), F.greatest(a["best"], more(a, v)).alias("best")), lambda a: a["best"])
    return F.when(F.length(token) > 1, let(token.cast("binary"), total)).otherwise(zero)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, each kind gated by a plain search, sorted by start and kind."""
    low = ascii_lower(text)
    assign = F.filter(match_spans(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 6)
    words = [low.contains(w) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")]
    named = words[0]
    for w in words[1:]:
        named = named | w
    found = F.concat(
        F.when(named, assign).otherwise(no_spans()),
        F.when(text.contains("AKIA"), match_spans(text, ACCESS, 1)).otherwise(no_spans()),
        F.when(text.rlike(HEX), match_spans(text, HEX, 2)).otherwise(no_spans()),
    )
    return F.array_sort(found)


def markov_spans(text: Column, base: Column, tables: list[Column], thresholds: tuple[int, ...], shortest: int) -> Column:
    """Tokens of at least `shortest` characters that look random for some family and lie in no base span."""
    token = rf"(?<![{TOKEN_CHARS}])[{TOKEN_CHARS}]{{{shortest},}}"
    tokens = F.when(text.rlike(token), match_spans(text, token, 3)).otherwise(no_spans())

    def outside(both: Column) -> Column:
        """Of base spans and tokens by start, the tokens that end beyond every base span that starts no later."""
        tops = running(F.transform(both, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(F.lit(0))), F.greatest)
        return let(tops, lambda t: F.filter(both, lambda s, i: (s["kind"] == 3) & (F.get(t, i) < s["end"])))

    by_start = F.array_sort(F.concat(base, tokens), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    alone = F.when(F.size(base) > 0, let(by_start, outside)).otherwise(tokens)

    def random(s: Column) -> Column:
        found = F.lit(False)
        for table, least in zip(tables, thresholds, strict=True):
            found = found | (best_stretch(s["hit"], table) >= least)
        return found

    return F.filter(alone, random)


def secret_spans(text: Column, tables: list[list[int]], thresholds: tuple[int, ...] = THRESHOLDS, shortest: int = SHORTEST) -> Column:
    """Struct (base, spans): arrays of struct<start, end, kind, hit>, both sorted by start, then kind."""
    ratios = [F.split(F.lit(",".join(map(str, t))), ",").cast("array<int>") for t in tables]  # each folded to one literal
    return let(
        whole(text),
        lambda t: let(base_spans(t), lambda b: F.struct(b.alias("base"), F.array_sort(F.concat(b, markov_spans(t, b, ratios, thresholds, shortest))).alias("spans"))),
    )


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def scan_secrets(docs: DataFrame, samples: DataFrame | None = None, thresholds: tuple[int, ...] = THRESHOLDS, shortest: int = SHORTEST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every row, repeated rows included.

    Null and empty texts have no spans. Very long texts are read whole, in time that grows with them. Spans that start together are in
    the order of their kinds; a random token inside a base span is that span. Tokens of fewer than `shortest` characters are no
    candidates: over so few steps a word and a random string look alike. A narrow job: one scan, no shuffle. Other columns of
    docs are not read.
    """
    tables = train(samples if samples is not None else builtin_samples(docs.sparkSession))
    found = secret_spans(F.col(text), tables, thresholds, shortest)
    return docs.select(F.col(doc_id).alias("doc_id"), found.alias("s")).select("doc_id", "s.base", "s.spans")


def redact(docs: DataFrame, samples: DataFrame | None = None, thresholds: tuple[int, ...] = THRESHOLDS, mark: str = "[secret]") -> DataFrame:
    """docs with every span of its text replaced by mark and n_chars brought up to date; no row is dropped.

    Null texts stay null, empty ones empty; an empty table stays empty; repeated rows are changed alike. The columns are those of
    docs, whatever their names.
    """
    tables = train(samples if samples is not None else builtin_samples(docs.sparkSession))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    found = docs.select(row, secret_spans(docs["text"], tables, thresholds)["spans"].alias("_found"))
    marked = found.select("_row", merged(F.col("_found")).alias("_spans"))
    text = F.when(F.size("_spans") > 0, replaced(F.col("_row.text"), F.col("_spans"), mark)).otherwise(F.col("_row.text"))
    marked = marked.withColumn("_text", text)
    own = {"text": F.col("_text"), "n_chars": F.when(F.size("_spans") > 0, F.length("_text")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    kinds = dict(docs.dtypes)
    return marked.select(*[own[c].cast(kinds[c]).alias(c) if c in own else F.col("_row").getField(c).alias(c) for c in docs.columns])


__all__ = ["SPAN", "base_spans", "best_stretch", "builtin_samples", "redact", "scan_secrets", "secret_spans", "spelled", "train"]
