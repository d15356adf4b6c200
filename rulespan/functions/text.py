"""Text helpers as native Column expressions.

Whitespace and word characters follow Python's Unicode rules, spelled out as character classes because
``\\s`` and ``\\w`` are ASCII in Java by default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Characters Python treats as white space, and the regex classes built from them.
SPACE_CODES = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
SPACE_CHARS = "".join(map(chr, SPACE_CODES))
# A class of many ranges asks each of them for every character; the property asks once.
WS = r"[\x{1c}\x{1d}\x{1e}\x{1f}\p{IsWhite_Space}]"
NOT_WS = "[^" + WS[1:]
WORD = r"[\p{L}\p{N}_]"
TOKEN = rf"'[tT](?:is|was|Is|Was|IS|WAS)\b|{WORD}+(?:['’-]{WORD}+)*|[^{WS[1:-1]}\p{{L}}\p{{N}}_]"
# The contractions a Treebank tokeniser splits, in order; each pattern is the two parts of a whole token.
CONTRACTIONS = (
    r"([^']*[^'])('[sSmMdD]|'ll|'LL|'re|'RE|'ve|'VE|n't|N'T)", r"(?i)(can)(not)", r"(?i)(d)('ye)", r"(?i)(gim)(me)",
    r"(?i)(gon)(na)", r"(?i)(got)(ta)", r"(?i)(lem)(me)", r"(?i)(more)('n)", r"(?i)(wan)(na)", r"(?i)('t)(is|was)",
)
# Those among them without an apostrophe.
PLAIN_CONTRACTIONS = ("cannot", "gimme", "gonna", "gotta", "lemme", "wanna")
# Between the parts of a split token; a control character no token carries.
_PART = chr(1)
REGEX_META = r"[\\.^$|?*+()\[\]{}]"

# Marker for a run of dots while sentences are split; a private-use character no text carries.
_DOT = chr(0xE000)


def bound_once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    A column used once inside a lambda is inlined by the optimiser and then evaluated for every array element; a
    lambda variable over a one-element array is not.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def strip(v: Column) -> Column:
    return F.trim(v, F.lit(SPACE_CHARS))


def is_blank(v: Column) -> Column:
    return strip(v) == ""


def words(v: Column) -> Column:
    """White-space words, no empty entries."""
    return F.filter(F.split(v, WS + "+"), lambda w: w != "")


def word_count(v: Column) -> Column:
    return F.regexp_count(v, F.lit(WORD + "+"))


def word_tokens(v: Column) -> Column:
    """Word and punctuation tokens; contractions are split in two ("don't" into "do" and "n't"), hyphenated words are not."""
    tokens = F.regexp_extract_all(v, F.lit(TOKEN), F.lit(0))
    any_form = "|".join(f"(?:{c})" for c in CONTRACTIONS)

    def parts(t: Column) -> Column:
        for pattern in CONTRACTIONS:
            t = F.regexp_replace(t, f"^(?:{pattern})$", f"$1{_PART}$2")
        return F.split(t, _PART, -1)

    def contracted(t: Column) -> Column:
        # Every form but the plain ones holds an apostrophe; only such tokens meet the patterns.
        return (t.contains("'") | F.lower(t).isin(*PLAIN_CONTRACTIONS)) & t.rlike(f"^(?:{any_form})$")

    def split(found: Column) -> Column:
        return F.flatten(F.transform(found, lambda t: F.when(contracted(t), parts(t)).otherwise(F.array(t))))

    # Most texts hold no contraction: their tokens stay as they are found.
    return bound_once(tokens, lambda found: F.when(F.exists(found, contracted), split(found)).otherwise(found))


def lit_replace(v: Column, old: str, new: str) -> Column:
    return F.replace(v, F.lit(old), F.lit(new))


def literal_count(v: Column, piece: Column) -> Column:
    """Non-overlapping occurrences of a literal piece of text."""
    gone = F.replace(v, piece, F.lit(""))
    return F.when(F.length(piece) > 0, (F.length(v) - F.length(gone)) / F.length(piece)).cast("int")


# Abbreviation rules of the sentence splitter, applied in this order. "<prd>" protects a dot.
ABBREVIATION_STEPS_BEFORE_DOTS = (
    (r"(Mr|St|Mrs|Ms|Dr)[.]", r"$1<prd>"),
    (r"[.](com|net|org|io|gov|edu|me)", r"<prd>$1"),
    (r"([0-9])[.]([0-9])", r"$1<prd>$2"),
)
SENTENCE_STARTERS = (
    rf"(Mr|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|He{WS}|She{WS}|It{WS}|They{WS}|Their{WS}|Our{WS}|We{WS}|But{WS}|However{WS}"
    rf"|That{WS}|This{WS}|Wherever)"
)
ABBREVIATION_STEPS_AFTER_DOTS = (
    (rf"{WS}([A-Za-z])[.] ", r" $1<prd> "),
    (r"([A-Z][.][A-Z][.](?:[A-Z][.])?) " + SENTENCE_STARTERS, r"$1<stop> $2"),
    (r"([A-Za-z])[.]([A-Za-z])[.]([A-Za-z])[.]", r"$1<prd>$2<prd>$3<prd>"),
    (r"([A-Za-z])[.]([A-Za-z])[.]", r"$1<prd>$2<prd>"),
    (r" (Inc|Ltd|Jr|Sr|Co)[.] " + SENTENCE_STARTERS, r" $1<stop> $2"),
    (r" (Inc|Ltd|Jr|Sr|Co)[.]", r" $1<prd>"),
    (r" ([A-Za-z])[.]", r" $1<prd>"),
)
QUOTE_SWAPS = ((".”", "”."), ('."', '".'), ('!"', '"!'), ('?"', '"?'))


def marked_sentences(v: Column) -> Column:
    """The text with ``<stop>`` after every sentence."""
    t = F.concat(F.lit(" "), lit_replace(v, "\n", " "), F.lit("  "))
    for pattern, put in ABBREVIATION_STEPS_BEFORE_DOTS:
        t = F.regexp_replace(t, pattern, put)
    # A run of n >= 2 dots becomes n protected dots and one stop.
    t = lit_replace(lit_replace(t, "..", _DOT * 2), _DOT + ".", _DOT * 2)
    t = lit_replace(F.regexp_replace(t, f"({_DOT}+)", "$1<stop>"), _DOT, "<prd>")
    t = lit_replace(t, "Ph.D.", "Ph<prd>D<prd>")
    for pattern, put in ABBREVIATION_STEPS_AFTER_DOTS:
        t = F.regexp_replace(t, pattern, put)
    for old, new in QUOTE_SWAPS:
        t = lit_replace(t, old, new)
    for mark in ".?!":
        t = lit_replace(t, mark, mark + "<stop>")
    return lit_replace(t, "<prd>", ".")


def sentences(v: Column) -> Column:
    """Trimmed sentences; one blank entry at the end is dropped, blanks elsewhere stay."""
    body = F.regexp_replace(marked_sentences(v), rf"<stop>{WS}*\z", "")
    return F.when(is_blank(v), F.array().cast("array<string>")).otherwise(
        F.transform(F.split(body, "<stop>", -1), strip)
    )


def paragraphs_starred(v: Column) -> Column:
    return F.split(v, rf"{WS}?\*\*\*{WS}?", -1)


def paragraphs_blank_line(v: Column) -> Column:
    return F.split(v, "\n\n", -1)


def non_blank(parts: Column) -> Column:
    return F.filter(parts, lambda p: ~is_blank(p))


def blank_inside(parts: Column) -> Column:
    """A blank part that is neither first nor last."""
    return F.exists(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), is_blank)


def all_upper(v: Column) -> Column:
    return (F.upper(v) == v) & (F.lower(v) != v)


def all_lower(v: Column) -> Column:
    return (F.lower(v) == v) & (F.upper(v) != v)


# Frequent function words and telling letters per language code; languages are grouped by script.
FUNCTION_WORDS = {
    "ar": "في من على إلى أن هذا التي مع عن كان",
    "bg": "на и да се за от не е са по като ще това",
    "de": "der die das und ist nicht ein eine mit von zu den auf für im dem sich des auch werden",
    "en": "the of and to in that is it for was with as on are this be by an not from",
    "es": "el los las una que y en por con para del se lo como más pero su al este son",
    "fa": "و در به از که این را با است برای",
    "fi": "ja on ei että se hän oli mutta kun niin ovat myös tai",
    "fr": "le les des et est une dans que pour qui sur pas au plus par avec ce il elle sont",
    "hi": "के है में की और का से को पर यह हैं नहीं",
    "it": "il gli di che è un una per con non sono del della nel alla dei più anche come questo",
    "mr": "आहे आणि या च्या ते हे मध्ये होते आहेत व",
    "ne": "र छ मा को हो छन् यो भने पनि थियो",
    "pl": "w nie na się z do to że jest jak ale od po przez",
    "pt": "o os as um uma que não em por com para do da no na mais como mas ao são",
    "ru": "и в не на что он с как это по но она из",
    "sw": "na ya wa kwa ni katika la za kuwa hii cha hiyo",
    "uk": "і в не на що та з до як це але він",
    "ur": "کے میں کی ہے اور سے کا کو پر یہ",
    "vi": "và của là có không được các cho một trong với người",
}
TELLING_LETTERS = {
    "bg": "[ъщ]", "de": "[ßäöü]", "es": "[ñ¿¡íóú]", "fa": "[پچژگ]", "fi": "[äö]", "fr": "[éèêçàùâîôœ]", "mr": "[ळ]",
    "pl": "[ąćęłńśźż]", "pt": "[ãõ]", "ru": "[ыэё]", "uk": "[іїєґ]", "ur": "[ٹڈڑںےہھ]", "vi": "[đăơưạảấầậắẹếềểệịọốồộớờợụứừữự]",
}
#: Points of a function word and of a telling letter.
WORD_POINTS, LETTER_POINTS = 3, 1
# Languages that a script alone names, and those that share one; the first is taken without any vote.
OWN_SCRIPT = {
    "Bengali": "bn", "Gujarati": "gu", "Gurmukhi": "pa", "Han": "zh", "Hangul": "ko", "Hebrew": "he", "Hiragana": "ja",
    "Kannada": "kn", "Katakana": "ja", "Malayalam": "ml", "Tamil": "ta", "Telugu": "te", "Thai": "th",
}
SHARED_SCRIPT = {
    "Arabic": ("ar", "fa", "ur"), "Cyrillic": ("ru", "bg", "uk"), "Devanagari": ("hi", "mr", "ne"),
    "Latin": ("en", "de", "es", "fi", "fr", "it", "pl", "pt", "sw", "vi"),
}


def _vote(v: Column, codes: tuple[str, ...]) -> Column:
    """The code with most points; ties go to the code listed first.

    The text is cut into runs of letters once; each language then counts its words among the function words found, and
    its letters in what is left without ASCII (no telling letter is ASCII).
    """
    listed = {c: FUNCTION_WORDS[c].split() for c in codes}
    any_word = sorted({w for words in listed.values() for w in words})

    def points(code: str, found: Column, rest: Column) -> Column:
        words = F.size(F.filter(found, lambda w: w.isin(*listed[code])))
        telling = TELLING_LETTERS.get(code)
        return WORD_POINTS * words + (LETTER_POINTS * F.regexp_count(rest, F.lit(telling)) if telling else 0)

    def elected(x: Column) -> Column:
        ballots = F.array(*[F.struct(points(c, x["found"], x["rest"]).alias("n"), F.lit(c).alias("code")) for c in codes])
        first = F.struct(F.lit(-1).alias("n"), F.lit(None).cast("string").alias("code"))
        return F.aggregate(ballots, first, lambda best, b: F.when(b["n"] > best["n"], b).otherwise(best))["code"]

    def counted(low: Column) -> Column:
        runs = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
        found = F.filter(runs, lambda w: w.isin(*any_word))
        return bound_once(F.struct(found.alias("found"), F.regexp_replace(low, r"[\x00-\x7f]+", "").alias("rest")), elected)

    return bound_once(F.lower(v), counted)


def detected_language(v: Column) -> Column:
    """Language code by script, then by function words and telling letters inside it; null without any letter.

    Deviation: a trained n-gram detector is not available. Kana decides for Japanese, however much Han is around it.
    """
    scripts = [*SHARED_SCRIPT, *OWN_SCRIPT]
    tally = F.array(*[F.struct(F.regexp_count(v, F.lit(rf"\p{{Is{s}}}")).alias("n"), F.lit(s).alias("s")) for s in scripts])
    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("s"))
    most = F.aggregate(tally, none, lambda best, x: F.when(x["n"] > best["n"], x).otherwise(best))["s"]
    script = F.when(most == "Han", F.when(v.rlike(r"[\p{IsHiragana}\p{IsKatakana}]"), "Hiragana").otherwise("Han")).otherwise(most)
    # Nearly all texts are Latin: the other scripts are counted only where such a letter occurs.
    only_latin = ~v.rlike(r"[[^\x00-\x7f]&&\p{L}&&[^\p{IsLatin}]]")

    def named(s: Column) -> Column:
        code = F.create_map(*[F.lit(x) for pair in OWN_SCRIPT.items() for x in pair])[s]
        for shared, codes in SHARED_SCRIPT.items():
            code = F.when(s == shared, _vote(v, codes)).otherwise(code)
        return code

    latin = F.when(v.rlike(r"\p{L}"), _vote(v, SHARED_SCRIPT["Latin"]))
    return F.when(only_latin, latin).otherwise(bound_once(script, named))


def valid_json(v: Column) -> Column:
    """True when the text is one JSON value.

    The text is placed in an array and in an object: only one complete value fits both places, so trailing
    content is rejected. Raw-string targets accept repeated keys, as a standard JSON reader does.
    """
    options = {"allowSingleQuotes": "false"}
    in_list = F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>", options)
    in_object = F.from_json(F.concat(F.lit('{"v":'), v, F.lit("}")), "struct<v:string>", options)
    # The parser also reads INF forms, which no JSON reader accepts; strings may hold anything, so they are blanked out.
    infinite = F.regexp_replace(v, r'"(?:[^"\\]|\\.)*+"', '""').rlike(r"\bINF\b")
    # Most texts fail in the parser at their first word, so the text is searched for INF only behind it.
    return F.coalesce(
        (v == "null")
        | ((F.size(in_list) == 1) & F.get(in_list, F.lit(0)).isNotNull() & in_object["v"].isNotNull()),
        F.lit(False),
    ) & ~F.coalesce(infinite, F.lit(False))
