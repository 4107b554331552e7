"""Text analysis of street names: index chain and query chain.

The steps take and give SQL text over column names, to be used with ``F.expr``; a whole
chain is one projection. Entries are ``struct<pos, ord, term>``, which is the
stream order: ``ord`` tells the tokens at one position apart (0 word, 1 initial, 2 and
more number synonyms).
"""

from __future__ import annotations

from functools import lru_cache

from esquina.functions.text import fold_sql

# Private-use characters around what an abbreviation rule matched.
OPEN, CLOSE = "\ue010", "\ue011"

ENTRY = "STRUCT<pos: INT, ord: INT, term: STRING>"

# Abbreviations and what they stand for; case matters.
ABBREVIATIONS = {
    "av.": "avenida", "avda": "avenida", "av": "avenida",
    "gral": "general", "gral.": "general", "grl": "general",
    "cnel": "coronel", "cap.": "capitan", "dr.": "doctor", "pte": "presidente",
    "s.": "san", "sto": "santo", "sta": "santa",
}

# Stop words of street names.
HONORIFICS = [
    "avenida", "av", "av.", "avda", "calle", "fray", "gral", "gral.", "general",
    "dr", "dr.", "pte", "pte.", "presidente", "mons", "monseñor", "monsenor", "pbro", "pbro.",
]
CONNECTORS = ["de", "del", "la", "las", "los", "y"]

# Number words.
THIRTY_ONE = ["treinta", "y", "uno"]
NUMBER_WORDS = [
    "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez",
    "once", "doce", "trece", "catorce", "quince", "dieciseis", "diecisiete", "dieciocho", "diecinueve", "veinte",
    "veintiuno", "veintidos", "veintitres", "veinticuatro", "veinticinco", "veintiseis", "veintisiete",
    "veintiocho", "veintinueve", "treinta",
]

# Shingle and prefix sizes.
SHINGLE_MAX = 3
EDGE_MIN, EDGE_MAX = 3, 15

# Tags that do not break a word, and common entities.
INLINE_TAGS = "a|abbr|b|em|i|small|span|strong|sub|sup|u"
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'",
    "&aacute;": "á", "&eacute;": "é", "&iacute;": "í", "&oacute;": "ó", "&uacute;": "ú",
    "&ntilde;": "ñ", "&uuml;": "ü", "&amp;": "&",
}


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replace_all(sql: str, table: dict[str, str]) -> str:
    for old, new in table.items():
        sql = f"replace({sql}, {quoted(old)}, {quoted(new)})"
    return sql


def html_strip(s: str) -> str:
    """Script, style and comment bodies go; inline tags vanish; other tags break the line."""
    plain = s
    for pattern in (
        r"(?is)<script\b[^>]*>.*?</script\s*>",
        r"(?is)<style\b[^>]*>.*?</style\s*>",
        r"(?s)<!--.*?-->",
    ):
        plain = f"regexp_replace({plain}, {quoted(pattern)}, ' ')"
    plain = f"regexp_replace({plain}, {quoted(rf'(?i)</?({INLINE_TAGS})(\s[^>]*)?/?>')}, '')"
    plain = f"regexp_replace({plain}, {quoted(r'</?[A-Za-z!?][^>]*>')}, '\\n')"
    # Most texts have neither tags nor entities and are not searched for each of them.
    plain = f"IF(contains({s}, '<'), {plain}, {s})"
    return f"IF(contains({s}, '&'), {_replace_all(plain, ENTITIES)}, {plain})"


def collapse_spaces(s: str) -> str:
    return f"regexp_replace({s}, {quoted(chr(92) + 's+')}, ' ')"


def expand_abbreviations(s: str) -> str:
    """One left-to-right pass, the longest rule first, inside words too.

    A regular expression marks what it matches; the marked texts are then replaced, so
    that no rule sees the output of another.
    """
    rules = sorted(ABBREVIATIONS, key=len, reverse=True)
    pattern = "(" + "|".join(r.replace(".", r"\.") for r in rules) + ")"
    marked = f"regexp_replace({s}, {quoted(pattern)}, '{OPEN}$1{CLOSE}')"
    return _replace_all(marked, {OPEN + r + CLOSE: ABBREVIATIONS[r] for r in rules})


def words(s: str) -> str:
    return f"regexp_extract_all({s}, {quoted(r'([\p{L}\p{N}]+)')}, 1)"


def fold(s: str) -> str:
    """Lower case without accents; also the keyword normaliser."""
    return fold_sql(f"lower({s})")


def street_words(s: str) -> str:
    """Character filters, folding and word split of the street field.

    Folding gives letters for letters, so words can be split first; only those with other than ASCII signs are folded.
    """
    split = words(f"lower({expand_abbreviations(collapse_spaces(html_strip(s)))})")
    return f"transform({split}, w -> IF(length(w) = octet_length(w), w, {fold_sql('w')}))"


def plain_words(s: str) -> str:
    """Words of the as-you-type field: no street rules, accents kept."""
    return words(f"lower({s})")


def _entry(term: str, pos: str, order: int) -> str:
    return f"named_struct('pos', {pos}, 'ord', {order}, 'term', {term})"


def _number_map() -> str:
    pairs = []
    for n, word in enumerate(NUMBER_WORDS, start=1):
        pairs += [quoted(str(n)), quoted(word), quoted(word), quoted(str(n))]
    return f"map({', '.join(pairs)})"


def with_initials(ws: str) -> str:
    """Words as entries; one that starts with two letters also gives its initial."""
    both = f"array({_entry('w', 'i', 0)}, {_entry('left(w, 1)', 'i', 1)})"
    one = f"array({_entry('w', 'i', 0)})"
    return f"flatten(transform({ws}, (w, i) -> IF(w RLIKE {quoted(r'^\p{L}{2}')}, {both}, {one})))"


def with_numbers(entries: str, ws: str) -> str:
    """Adds the other spelling of the numbers 1 to 31 at the same position."""
    none = f"CAST(array() AS ARRAY<{ENTRY}>)"
    single = f"IF(element_at(m, x.w) IS NULL, {none}, array({_entry('element_at(m, x.w)', 'x.i', 2)}))"
    parts = [_entry(quoted(t), f"x.i + {k}", 3 + k) for k, t in enumerate(THIRTY_ONE)]
    spelled = f"IF(x.w = '31', array({', '.join(parts)}), {none})"
    follows = " AND ".join(f"get({ws}, x.i + {k}) = {quoted(t)}" for k, t in enumerate(THIRTY_ONE) if k)
    joined = f"IF(x.w = {quoted(THIRTY_ONE[0])} AND {follows}, array({_entry(quoted('31'), 'x.i', 6)}), {none})"
    numbers = f"filter(transform({ws}, (w, i) -> named_struct('w', w, 'i', i)), x -> {_is_number('x.w')})"
    synonyms = f"flatten(transform({numbers}, x -> concat({single}, {spelled}, {joined})))"
    bound = f"get(transform(array({_number_map()}), m -> {synonyms}), 0)"
    return f"IF(exists({ws}, w -> {_is_number('w')}), sort_array(concat({entries}, {bound})), {entries})"


def _is_number(w: str) -> str:
    known = [str(n) for n in range(1, 32)] + NUMBER_WORDS
    return f"{w} IN ({', '.join(map(quoted, known))})"


# The Spanish stop words that the analysis chain names, without the verb forms below.
SPANISH_WORDS = (
    "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque "
    "esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra "
    "otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes "
    "nada muchos cual poco ella estar estas algunas algo nosotros mi mis tú te ti tu tus ellas nosotras vosostros "
    "vosostras os mío mía míos mías tuyo tuya tuyos tuyas suyo suya suyos suyas nuestro nuestra nuestros nuestras "
    "vuestro vuestra vuestros vuestras esos esas"
).split()
# Stem and endings of the conjugated auxiliaries in the same list.
SPANISH_VERBS = (
    ("est", "oy ás á amos áis án é és emos éis én ando ado ada ados adas ad"),
    ("estar", "é ás á emos éis án ía ías íamos íais ían"),
    ("est", "aba abas ábamos abais aban"),
    ("h", "e as a emos an"), ("hab", "éis iendo ido ida idos idas"),
    ("hay", "a as amos áis an"), ("habr", "é ás á emos éis án ía ías íamos íais ían"), ("hab", "ía ías íamos íais ían"),
    ("", "soy eres es somos sois son eras éramos erais era eran"), ("se", "a as amos áis an"),
    ("ser", "é ás á emos éis án ía ías íamos íais ían"),
    ("f", "ui uiste ue uimos uisteis ueron uera ueras uéramos uerais ueran uese ueses uésemos ueseis uesen"),
    ("s", "intiendo entido entida entidos entidas iente entid"),
    ("t", "engo ienes iene enemos enéis ienen eniendo enido enida enidos enidas ened"),
    ("teng", "a as amos áis an"), ("tendr", "é ás á emos éis án ía ías íamos íais ían"), ("ten", "ía ías íamos íais ían"),
)
SPANISH_PAST_STEMS = ("estuv", "hub", "tuv")
SPANISH_PAST = (
    "e iste o imos isteis ieron iera ieras iéramos ierais ieran iese ieses iésemos ieseis iesen"
).split()


@lru_cache(maxsize=1)
def spanish_stop_words() -> tuple[str, ...]:
    verbs = [stem + end for stem, ends in SPANISH_VERBS for end in ends.split()]
    past = [stem + end for stem in SPANISH_PAST_STEMS for end in SPANISH_PAST]
    return (*SPANISH_WORDS, *verbs, *past)


def without(entries: str, stop: list[str]) -> str:
    """Drops stop words; the positions of the others stay."""
    return f"filter({entries}, e -> e.term NOT IN ({', '.join(map(quoted, sorted(set(stop))))}))"


def query_entries(ws: str) -> str:
    """Everything after the word split, for queries. ``ws`` is a column name."""
    entries = with_numbers(with_initials(ws), ws)
    return without(entries, [*HONORIFICS, *CONNECTORS, *spanish_stop_words()])


def stream_runs(entries: str) -> str:
    """Entries with the two terms that follow in stream order, null at the end: what shingles are made of."""
    parts = ", ".join(f"'next{k}', get({entries}, i + {k}).term" for k in range(1, SHINGLE_MAX))
    return f"transform({entries}, (e, i) -> named_struct('pos', e.pos, 'term', e.term, {parts}))"


def shingles(entries: str) -> str:
    """Single terms and runs of two and three, in stream order, at the first position."""
    runs = ["e.term"]
    for size in range(2, SHINGLE_MAX + 1):
        parts = ", ' ', ".join(["e.term"] + [f"get({entries}, i + {k}).term" for k in range(1, size)])
        runs.append(f"concat({parts})")
    made = ", ".join(_entry(r, "e.pos", n) for n, r in enumerate(runs))
    return f"filter(flatten(transform({entries}, (e, i) -> array({made}))), e -> e.term IS NOT NULL)"


def edge_grams(entries: str) -> str:
    """Prefixes of 3 to 15 characters; shorter terms vanish."""
    size = f"least(length(e.term), {EDGE_MAX})"
    cut = f"transform(sequence({EDGE_MIN}, {size}), n -> {_entry('left(e.term, n)', 'e.pos', 0)})"
    none = f"CAST(array() AS ARRAY<{ENTRY}>)"
    return f"flatten(transform({entries}, e -> IF(length(e.term) >= {EDGE_MIN}, {cut}, {none})))"
