"""Column functions over text: the normalisation chain, keys, tokens, n-grams, hosts, transliteration.

All are built-in expressions, so they stay in generated code; a null stays null.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Look-alike quotes and what they stand for.
QUOTES = {"‹": '"', "›": '"', "«": '"', "»": '"', "′": "'", "‘": "'", "’": "'", "“": '"', "”": '"'}
# Latin punctuation and the word space, as Ethiopic text writes them.
PUNCTUATION = {"፡": " ", ",": "፣", ";": "፤", ":": "፥", "?": "፧"}
# Homophone letters, each with the one it is merged into.
HOMOPHONES = {
    "ሐ": "ሀ", "ሑ": "ሁ", "ሒ": "ሂ", "ሓ": "ሃ", "ሔ": "ሄ", "ሕ": "ህ", "ሖ": "ሆ", "ኀ": "ሀ",
    "ኁ": "ሁ", "ኂ": "ሂ", "ኃ": "ሃ", "ኄ": "ሄ", "ኅ": "ህ", "ኆ": "ሆ", "ሗ": "ኋ", "ዃ": "ኋ",
    "ሠ": "ሰ", "ሡ": "ሱ", "ሢ": "ሲ", "ሣ": "ሳ", "ሤ": "ሴ", "ሥ": "ስ", "ሦ": "ሶ", "ሧ": "ሷ",
    "ዐ": "አ", "ዑ": "ኡ", "ዒ": "ኢ", "ዓ": "ኣ", "ዔ": "ኤ", "ዕ": "እ", "ዖ": "ኦ", "ፀ": "ጸ",
    "ፁ": "ጹ", "ፂ": "ጺ", "ፃ": "ጻ", "ፄ": "ጼ", "ፅ": "ጽ", "ፆ": "ጾ",
}
# Letters of the second order, each with the labialised letter that it stands for before WA and A.
LABIALISED = {
    "ሉ": "ሏ", "ሑ": "ሗ", "ሙ": "ሟ", "ሡ": "ሧ", "ሩ": "ሯ", "ሱ": "ሷ", "ሹ": "ሿ", "ቡ": "ቧ",
    "ቩ": "ቯ", "ቱ": "ቷ", "ቹ": "ቿ", "ኑ": "ኗ", "ኙ": "ኟ", "ዙ": "ዟ", "ዡ": "ዧ", "ዱ": "ዷ",
    "ዹ": "ዿ", "ጁ": "ጇ", "ጡ": "ጧ", "ጩ": "ጯ", "ጱ": "ጷ", "ጹ": "ጿ", "ፉ": "ፏ", "ፑ": "ፗ",
    "ቁ": "ቋ", "ቑ": "ቛ", "ኁ": "ኋ", "ኩ": "ኳ", "ኹ": "ዃ", "ጉ": "ጓ",
}
LABIAL_SUFFIX = "ዋአ"

# The white space of Unicode, and how lower case still differs from folded case.
SPACES = " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
FOLDS = {"ß": "ss", "ſ": "s", "ς": "σ", "ŉ": "ʼn", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# A class of its own is several times as fast as \s with the Unicode flag.
SPACE = "[" + SPACES + "]"


def _translate(column: Column, table: dict[str, str]) -> Column:
    return F.translate(column, "".join(table), "".join(table.values()))


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(SPACES))


def plain_quotes(column: Column) -> Column:
    return _translate(column, QUOTES)


def labialise(column: Column) -> Column:
    return F.when(column.contains(LABIAL_SUFFIX), reduce(lambda c, p: F.replace(c, F.lit(p[0] + LABIAL_SUFFIX), F.lit(p[1])), LABIALISED.items(), column)).otherwise(column)


def merge_homophones(column: Column) -> Column:
    return _translate(column, HOMOPHONES)


def doubled_wordspace(column: Column) -> Column:
    return F.regexp_replace(column, "(?:፡" + SPACE + "*){2,}", "። ")


def ethiopic_punctuation(column: Column) -> Column:
    return _translate(column, PUNCTUATION)


def sentence_period(column: Column) -> Column:
    """A period before white space or the end, closing quotes between, is a full stop; dots in runs, numbers and abbreviations stay."""
    return F.regexp_replace(column, r"""(^|[^.])\.(["')]*)(""" + SPACE + r"|\z)", "$1።$2$3")


def collapse_space(column: Column) -> Column:
    # Single spaces, nearly all white space there is, are not matched.
    return strip(F.regexp_replace(column, "[" + SPACES[1:] + "]" + SPACE + "*| " + SPACE + "+", " "))


def nfc(column: Column) -> Column:
    """Unicode composition; only texts beyond ASCII leave the JVM, in Arrow batches."""
    @F.arrow_udf("string")
    def composed(texts: pa.Array) -> pa.Array:
        return compose(texts)

    beyond = column.rlike(r"[^\x00-\x7F]")
    return F.when(beyond, composed(F.when(beyond, column))).otherwise(column)  # for the others a null is sent


def compose(texts: pa.Array, rows_at_once: int = 256) -> pa.Array:
    """Each text in composed form; so many are Python objects at a time."""
    parts = (texts.slice(at, rows_at_once).to_pylist() for at in range(0, len(texts), rows_at_once))
    done = [pa.array([t if t is None else unicodedata.normalize("NFC", t) for t in part], pa.string()) for part in parts]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


#: The chain in its order: name, function, whether it is for both sides (or the Ethiopic one alone).
STEPS = [
    ("unicode", lambda c: strip(nfc(c)), True),
    ("quotes", plain_quotes, True),
    ("labialisation", labialise, False),
    ("homophones", merge_homophones, False),
    ("wordspace", doubled_wordspace, False),
    ("punctuation", ethiopic_punctuation, False),
    ("period", sentence_period, False),
    ("whitespace", collapse_space, False),
]


def normalise(column: Column, ethiopic: bool, unicode: bool = True) -> Column:
    return reduce(lambda c, s: s[1](c), [s for s in STEPS if (ethiopic or s[2]) and (unicode or s[0] != "unicode")], column)


def normalised(df: DataFrame, sides: dict[str, bool]) -> DataFrame:
    """Replaces columns by their normalised text; ``sides`` says of each whether it is the Ethiopic one.

    Step by step, so that no step's expression is repeated inside the next one's.
    """
    for _, function, both in STEPS:
        df = df.withColumns({c: function(F.col(c)) for c, ethiopic in sides.items() if ethiopic or both})
    return df


def length_bucket(column: Column, short: int = 40, long: int = 120) -> Column:
    return F.when(F.length(column) < short, "short").when(F.length(column) >= long, "long").otherwise("medium")


def content_key(*columns: Column) -> Column:
    """A null counts as an empty text, in its own place."""
    return F.sha1(F.concat_ws("\0", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)))


def casefold(column: Column) -> Column:
    """Lower case with what Unicode folds further, for the letters of :data:`FOLDS`."""
    return reduce(lambda c, f: F.replace(c, F.lit(f[0]), F.lit(f[1])), FOLDS.items(), F.lower(column))


def comparison_key(column: Column) -> Column:
    """Case folded, everything but word characters gone."""
    return F.regexp_replace(casefold(column), r"[^\p{L}\p{M}\p{N}_]+", "")


def word_tokens(column: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(casefold(column), r"[^\p{L}\p{M}\p{N}_]+", " "), " "), lambda w: w != "")


def word_ngrams(tokens: Column, n: int = 5) -> Column:
    """The set of word n-grams; a shorter text is one gram, an empty one has none."""
    gram = lambda i: F.array_join(F.slice(tokens, i, n), " ")
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), gram))
    return F.when(F.size(tokens) > 0, many).otherwise(F.array().cast("array<string>"))


def occurrences(column: Column, what: str) -> Column:
    return F.length(column) - F.length(F.replace(column, F.lit(what), F.lit("")))


def host(*urls: Column) -> Column:
    """Host of the first URL that there is, else ``unknown``."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(*urls), r"^https?://([^/?#]+)", 1), F.lit("")), F.lit("unknown"))


def unescape_html(column: Column) -> Column:
    """The five predefined references; the ampersand last, so nothing is decoded twice."""
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        column = F.replace(column, F.lit(name), F.lit(c))
    return column


def moses_tokens(column: Column) -> Column:
    """The core of Moses tokenisation for English: punctuation apart, numbers and contractions kept as they are written there."""
    for pattern, to in ((r"\s+", " "), (r"([^\p{L}\p{N}\s.'`,-])", " $1 "), (r"([^\p{N}]),", "$1 , "), (r",([^\p{N}])", " , $1"), (r"([^\p{L}])'", "$1 ' "), (r"(\p{L})'(\p{L})", "$1 '$2"), (r"\.\s*$", " ."), (r"\s+", " ")):
        column = F.regexp_replace(column, pattern, to)
    return F.trim(column)


def moses_detokens(column: Column) -> Column:
    """Undoes the spaces before closing and after opening punctuation."""
    for pattern, to in ((r" ([.,;:!?)\]%])", "$1"), (r"([(\[]) ", "$1"), (r" '(s|t|re|ve|ll|d|m)\b", "'$1")):
        column = F.regexp_replace(column, pattern, to)
    return column


# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = "ac.uk co.in co.jp co.ke co.kr co.nz co.uk co.za com.au com.br com.cn com.et com.mx com.ng com.tr edu.et gov.et gov.uk net.au org.au org.et org.uk".split()


def registered_domain(host_column: Column, suffixes: list[str] = TWO_LABEL_SUFFIXES) -> Column:
    """Public suffix and the label before it; ports and user parts cut, addresses and bare suffixes unknown."""
    name = F.lower(F.regexp_replace(F.regexp_replace(host_column, r"^.*@", ""), r":[0-9]*$", ""))
    labels = F.split(name, r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    n = F.when(two.isin(suffixes), 3).otherwise(2)
    return F.when(name.rlike(r"^[0-9.]+$") | (F.size(labels) < n), "unknown").otherwise(F.array_join(F.slice(labels, -n, n), "."))


def public_suffix_rules(df: DataFrame) -> DataFrame:
    """(rule, labels) from the lines of a public suffix list: ``labels`` is how many labels the suffix has, one less for exceptions."""
    rule = F.trim(F.regexp_extract("value", r"^\s*(\S*)", 1))
    rules = df.select(F.lower(rule).alias("rule")).filter((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    labels = F.size(F.split("rule", r"\."))
    return rules.select(F.regexp_replace("rule", "^!", "").alias("rule"), F.when(F.col("rule").startswith("!"), labels - 1).otherwise(labels).alias("labels"), F.col("rule").startswith("!").alias("exception")).distinct()


def registered_domains(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """(host, domain) of the distinct hosts by public suffix rules: an exception wins, then the longest rule, then one label.

    A rule's first label may be ``*``.  Addresses, bare suffixes and null hosts are unknown.
    """
    name = F.lower(F.regexp_replace(F.regexp_replace(F.col(host), r"^.*@", ""), r":[0-9]*$", ""))
    each = hosts.select(host).distinct().withColumn("_labels", F.split(name, r"\."))
    ends = F.transform(F.sequence(F.lit(1), F.size("_labels")), lambda i: F.array_join(F.slice("_labels", i, 1000), "."))
    starred = F.transform(F.sequence(F.lit(1), F.size("_labels")), lambda i: F.concat_ws(".", F.lit("*"), F.slice("_labels", i + 1, 1000)))
    asked = each.select(host, "_labels", F.explode(F.array_distinct(F.concat(ends, starred))).alias("rule"))
    best = asked.join(rules, "rule", "left").groupBy(host).agg(F.max(F.struct(F.coalesce("exception", F.lit(False)).alias("exception"), F.coalesce("labels", F.lit(1)).alias("labels"))).alias("best"), F.first("_labels").alias("_labels"))
    n = F.col("best.labels") + 1
    plain = F.array_join(F.slice("_labels", -n, n), ".")
    return best.select(host, F.when(F.array_join("_labels", ".").rlike(r"^[0-9.]*$") | (F.size("_labels") < n) | (F.col(host) == "unknown"), "unknown").otherwise(plain).alias("domain"))


def confidence(text: Column, probability: Column) -> Column:
    """A label's probability for a text: at most 1, and 0 for a text without a word or a label that has none."""
    return F.when(F.coalesce(collapse_space(text), F.lit("")) == "", 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(probability, F.lit(0.0))))


def length_penalty(length: Column, alpha: float) -> Column:
    """What a hypothesis' log probability is divided by to rank it."""
    return F.pow((F.lit(5.0) + length) / F.lit(6.0), F.lit(float(alpha)))


# ---------------------------------------------------------------- Ethiopic script

# Consonant rows of the Ethiopic block by first code point; each row has seven vowel orders and mostly a labialised eighth.
# The table of letters has over 300 entries and follows from the block's order, so it is built from that rule.
ROWS = {0x1200: "h", 0x1208: "l", 0x1210: "h", 0x1218: "m", 0x1220: "s", 0x1228: "r", 0x1230: "s", 0x1238: "š", 0x1240: "q", 0x1250: "q", 0x1260: "b", 0x1268: "v", 0x1270: "t", 0x1278: "c", 0x1280: "h", 0x1290: "n", 0x1298: "ñ", 0x12A8: "k", 0x12B8: "h", 0x12C8: "w", 0x12D8: "z", 0x12E0: "ž", 0x12E8: "y", 0x12F0: "d", 0x12F8: "ṗ", 0x1300: "j", 0x1308: "g", 0x1318: "g", 0x1320: "ṭ", 0x1328: "ċ", 0x1330: "ṗ", 0x1338: "ṣ", 0x1340: "ṣ", 0x1348: "f", 0x1350: "p"}
ORDERS = ["ə", "u", "i", "a", "e", "", "o", "ʷa"]
LABIAL_ROWS = {0x1248: "q", 0x1258: "q", 0x1288: "h", 0x12B0: "k", 0x12C0: "h", 0x1310: "g"}
LABIAL_ORDERS = {0: "o", 2: "u", 3: "ʷa", 4: "ʷa", 5: "u"}
VOWEL_ROWS = {0x12A0: "auiaeɨoə", 0x12D0: "auiaeɨo"}
# Letters that the rows do not give.
OTHER_LETTERS = {"ሀ": "ha", "ሐ": "ha", "ኀ": "ha", "ሇ": "ho", "ኇ": "ho", "ቇ": "qo", "ኯ": "ko", "ዏ": "wo", "ዯ": "yo", "ጏ": "go", "ፇ": "ṣo", "ፘ": "rʷa", "ፙ": "mʷa", "ፚ": "fʷa"}
NUMERALS = {"፩": 1, "፪": 2, "፫": 3, "፬": 4, "፭": 5, "፮": 6, "፯": 7, "፰": 8, "፱": 9, "፲": 10, "፳": 20, "፴": 30, "፵": 40, "፶": 50, "፷": 60, "፸": 70, "፹": 80, "፺": 90, "፻": 100, "፼": 10000}
MARKS = {"።": ".", "፣": ",", "፥": ":", "፤": ";", "፦": "-", "፡": " ", "፧": "?"}


def letters() -> dict[str, str]:
    """The transliteration of every letter, numeral and mark, from the rows above."""
    out = {chr(row + i): c + v for row, c in ROWS.items() for i, v in enumerate(ORDERS) if not (row in (0x12B8, 0x12C8) and i == 7)}
    out |= {chr(row + i): c + v for row, c in LABIAL_ROWS.items() for i, v in LABIAL_ORDERS.items()}
    out |= {chr(row + i): v for row, vowels in VOWEL_ROWS.items() for i, v in enumerate(vowels)}
    return out | OTHER_LETTERS | {k: str(v) for k, v in NUMERALS.items()} | MARKS


def numeral_value(token: Column) -> Column:
    """A lone numeral is its value; in longer ones a hundred or ten thousand multiplies what stands before by 100."""
    value = F.create_map(*(F.lit(x) for k, v in NUMERALS.items() for x in (k, v)))
    digits = F.filter(F.split(token, ""), lambda c: c != "")
    folded = F.aggregate(digits, F.lit(0).cast("long"), lambda acc, c: F.when(c.isin("፻", "፼"), acc * 100).otherwise(acc + value[c]))
    return F.when(F.length(token) == 1, value[token].cast("long")).otherwise(folded)


def transliterate(column: Column) -> Column:
    """Ethiopic to Latin, white space as single spaces; a token of numerals alone becomes its number.

    A letter is found by its code point's place in an array, so a text costs its length.
    """
    table = letters()
    low, high = min(map(ord, table)), max(map(ord, table))
    latin = F.array(*(F.lit(table.get(chr(c))) for c in range(low, high + 1)))
    digits, space = "".join(NUMERALS), r"(?U)\s+"
    numbers = F.transform(F.split(column, space), lambda t: F.when(t.rlike(f"^[{digits}]+$"), numeral_value(t).cast("string")).otherwise(t))
    numbered = F.when(column.rlike(f"[{digits}]"), F.array_join(numbers, " ")).otherwise(F.regexp_replace(column, space, " "))
    return F.array_join(F.transform(F.split(numbered, ""), lambda c: F.coalesce(F.get(latin, F.ascii(c) - low), c)), "")


def spell_ethiopic(column: Column) -> Column:
    """Latin to Ethiopic: at each place the longest spelling that the letters have.

    Where several letters share a spelling the first by code point stands for it, so only
    a text of such letters survives the way there and back.
    """
    spellings: dict[str, str] = {}
    for letter, latin in sorted(letters().items()):
        if latin and not latin.isdigit() and letter not in MARKS:
            spellings.setdefault(latin, letter)
    order = sorted(spellings, key=lambda k: (-len(k), k))
    table = F.create_map(*(F.lit(x) for k in order for x in (k, spellings[k])))
    pattern = "(?s)(" + "|".join(order) + "|.)"
    return F.array_join(F.transform(F.regexp_extract_all(column, F.lit(pattern), F.lit(1)), lambda g: F.coalesce(table[g], g)), "")


# ---------------------------------------------------------------- token ids

BOS, EOS, PAD = 2, 3, 0


UNK = 1


def unknown_rate(ids: Column, unknown: int = UNK) -> Column:
    """Share of unknown ids, 0 of none; a vocabulary above 0.2 cannot write the script and needs transliteration."""
    return F.size(F.filter(ids, lambda i: i == unknown)) / F.greatest(F.size(ids), F.lit(1))


def pad_mask(ids: Column) -> Column:
    """1 where there is a token, 0 where there is padding."""
    return F.transform(ids, lambda i: (i != PAD).cast("int"))


def frame_ids(ids: Column) -> Column:
    return F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS)))


def truncate_ids(ids: Column, most: int) -> Column:
    return F.when(F.size(ids) > most, F.concat(F.slice(ids, 1, most - 1), F.array(F.lit(EOS)))).otherwise(ids)


def pad_ids(ids: Column, width: Column) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(PAD), width - F.size(ids)))
