"""DuckDB SQL fragments for the oracles: plain brute force, no engine tricks."""

from __future__ import annotations
from contract import views as v
from esquina.functions import analysis as an
from esquina.functions import text as tx


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words_in(items) -> str:
    return ", ".join(q(i) for i in items)


def ctes(*pairs: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in pairs) + "\n"


STREETS = ("streets", v.STREETS)
ADDRESSES = ("address_requests", v.ADDRESS_REQUESTS)
INTERSECTIONS = ("intersections", v.INTERSECTIONS)
CROSSINGS = ("intersection_requests", v.INTERSECTION_REQUESTS)
SUGGESTS = ("suggest_requests", v.SUGGEST_REQUESTS)


# --- text ------------------------------------------------------------------

def fold(s: str) -> str:
    return f"replace(replace(replace(strip_accents({s}), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')"


def norm_text(s: str) -> str:
    return rf"regexp_replace({fold(f'lower(coalesce({s}, {q(str())}))')}, '\s+', ' ', 'g')"


def norm_code(s: str) -> str:
    return rf"upper(regexp_replace(coalesce({s}, ''), '\s+', '', 'g'))"


def name_tokens(norm: str) -> str:
    return f"list_filter(string_split({norm}, ' '), lambda t: t NOT IN ({words_in(tx.PREFIX_TOKENS)}))"


def pattern(toks: str) -> str:
    return f"CASE WHEN array_to_string({toks}, '') = '' THEN '%' ELSE '%' || array_to_string({toks}, '%') || '%' END"


def trigrams(norm: str) -> str:
    ws = rf"list_filter(string_split(regexp_replace({norm}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return (
        f"list_distinct(flatten(list_transform({ws}, lambda w: "
        f"list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def similarity(a: str, b: str) -> str:
    both = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {both} = 0 THEN 0e0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / {both} END"


def hits(toks: str, norm: str) -> str:
    return f"len(list_filter({toks}, lambda t: t <> '' AND contains({norm}, t)))"


def score(sim: str, like: str, n_hits: str) -> str:
    return f"round(greatest({sim}, CASE WHEN {like} THEN 0.7e0 ELSE 0e0 END, round({n_hits} * 0.15e0, 2)), 6)"


def named(texts: str) -> list[tuple[str, str]]:
    """CTEs up to ``scored``: every (q, name) pair with its score, from ``texts(q)``."""
    return [
        ("names", f"SELECT nombre_cal, min(numero_cal) AS numero_cal, {norm_text('nombre_cal')} AS nnorm FROM streets GROUP BY nombre_cal"),
        ("names3", f"SELECT *, {trigrams('nnorm')} AS grams FROM names"),
        ("asked", f"SELECT q, {norm_text('q')} AS qnorm FROM ({texts}) t"),
        ("asked2", f"SELECT *, {name_tokens('qnorm')} AS toks, {trigrams('qnorm')} AS qgrams FROM asked"),
        ("asked3", f"SELECT *, {pattern('toks')} AS pat FROM asked2"),
        ("pairs", f"""SELECT q, nombre_cal, numero_cal, {similarity('grams', 'qgrams')} AS sim,
            nnorm LIKE pat ESCAPE '\\' AS is_like, {hits('toks', 'nnorm')} AS hits FROM asked3, names3"""),
        ("scored", f"""SELECT q, nombre_cal, numero_cal, sim, is_like, {score('sim', 'is_like', 'hits')} AS score
            FROM pairs WHERE is_like OR sim > 0.35e0"""),
        ("ranked", """SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, nombre_cal ASC NULLS LAST) AS INT) AS rank
            FROM scored"""),
    ]


def resolved(texts: str) -> list[tuple[str, str]]:
    """CTEs up to ``resolved(q, code)``."""
    return [
        *named(texts),
        ("codes", f"SELECT {norm_code('numero_cal')} AS qcode, arg_min(numero_cal, id) AS by_code FROM streets GROUP BY 1"),
        ("resolved", f"""SELECT a.q, coalesce(c.by_code, r.numero_cal) AS code FROM asked a
            LEFT JOIN codes c ON c.qcode = {norm_code('a.q')}
            LEFT JOIN ranked r ON r.q = a.q AND r.rank = 1"""),
    ]


# --- addresses -------------------------------------------------------------

BOUNDS = ("bounds", f"""SELECT *, {norm_code('numero_cal')} AS code,
    greatest(least(alt_ini_pa, alt_fin_pa), 0) AS min_par, least(greatest(alt_ini_pa, alt_fin_pa), 999999) AS max_par,
    greatest(least(alt_ini_im, alt_fin_im), 0) AS min_impar, least(greatest(alt_ini_im, alt_fin_im), 999999) AS max_impar
    FROM streets""")


def chosen(requests: str) -> list[tuple[str, str]]:
    """CTEs up to ``placed`` from ``requests(req_id, code, altura, fallback)``."""
    return [
        BOUNDS,
        ("cand", f"""SELECT r.req_id, r.altura, b.*,
            CASE WHEN altura % 2 = 0 THEN min_par ELSE min_impar END AS lo,
            CASE WHEN altura % 2 = 0 THEN max_par ELSE max_impar END AS hi, r.fallback
            FROM ({requests}) r JOIN bounds b ON b.code = r.code"""),
        ("cand2", "SELECT *, altura BETWEEN least(lo, hi) AND greatest(lo, hi) AS in_range FROM cand"),
        ("best", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY req_id
            ORDER BY CASE WHEN in_range THEN 0 ELSE 1 END, hi - lo, id) AS rn FROM cand2 WHERE in_range OR fallback) t WHERE rn = 1"""),
        ("frac", """SELECT *, CASE WHEN hi = lo THEN 0.5e0
            ELSE CAST(least(greatest(altura, lo), hi) - lo AS DOUBLE) / (hi - lo) END AS f,
            sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0)) AS l1, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) AS l2 FROM best"""),
        ("placed", f"SELECT *, {along('x', 'f')} AS lon, {along('y', 'f')} AS lat FROM frac"),
    ]


def along(axis: str, f: str) -> str:
    a, b, c = f"{axis}0", f"{axis}1", f"{axis}2"
    return (
        f"CASE WHEN {f} <= 0 THEN {a} WHEN {f} >= 1 THEN {c} "
        f"WHEN {f} * (l1 + l2) <= l1 THEN {a} + ({b} - {a}) * ({f} * (l1 + l2) / l1) "
        f"ELSE {b} + ({c} - {b}) * (({f} * (l1 + l2) - l1) / l2) END"
    )


def to_lon(x: str) -> str:
    return f"degrees({x} / 6378137e0)"


def to_lat(y: str) -> str:
    return f"degrees(2 * atan(exp({y} / 6378137e0)) - pi() / 2)"


# --- analysis --------------------------------------------------------------

def html_strip(s: str) -> str:
    for p in (r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?s)<!--.*?-->"):
        s = f"regexp_replace({s}, {q(p)}, ' ', 'g')"
    s = f"regexp_replace({s}, {q(rf'(?i)</?({an.INLINE_TAGS})(\s[^>]*)?/?>')}, '', 'g')"
    s = f"regexp_replace({s}, '</?[A-Za-z!?][^>]*>', chr(10), 'g')"
    for k, val in an.ENTITIES.items():
        s = f"replace({s}, {q(k)}, {q(val)})"
    return s


def collapse(s: str) -> str:
    return rf"regexp_replace({s}, '\s+', ' ', 'g')"


def abbreviations(s: str) -> str:
    """Character by character: what the longest rule at a place gives, else the character."""
    rules = sorted(an.ABBREVIATIONS, key=len, reverse=True)
    alternatives = "|".join(r.replace(".", "\\.") for r in rules)
    cases = " ".join(f"WHEN {q(r)} THEN {q(an.ABBREVIATIONS[r])}" for r in rules)
    return (
        f"array_to_string(list_transform(regexp_extract_all({s}, {q(f'(?s)(?:{alternatives}|.)')}), "
        f"lambda c: CASE c {cases} ELSE c END), '')"
    )


def words(s: str) -> str:
    return rf"regexp_extract_all({s}, '[\p{{L}}\p{{N}}]+')"


def street_words(s: str) -> str:
    return words(fold(f"lower({abbreviations(collapse(html_strip(s)))})"))


def entries(source: str, key: str, text: str, prefix: str = "") -> list[tuple[str, str]]:
    """CTEs up to ``{prefix}stream(key, pos, ord, term)`` with stop words dropped."""
    p = prefix
    numbers = ", ".join(f"('{n}', '{w}'), ('{w}', '{n}')" for n, w in enumerate(an.NUMBER_WORDS, start=1))
    stop = words_in(sorted({*an.HONORIFICS, *an.CONNECTORS, *an.spanish_stop_words()}))
    return [
        (f"{p}split", f"SELECT {key} AS k, {street_words(text)} AS ws FROM {source}"),
        (f"{p}tok", f"SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM {p}split"),
        (f"{p}ahead", f"""SELECT *, lead(w, 1) OVER (PARTITION BY k ORDER BY pos) AS w1,
            lead(w, 2) OVER (PARTITION BY k ORDER BY pos) AS w2 FROM {p}tok"""),
        (f"{p}every", f"""SELECT k, pos, 0 AS ord, w AS term FROM {p}tok
            UNION ALL SELECT k, pos, 1, left(w, 1) FROM {p}tok WHERE regexp_matches(w, '^\\p{{L}}{{2}}')
            UNION ALL SELECT k, pos, 2, other FROM {p}tok JOIN (VALUES {numbers}) n(word, other) ON word = w
            UNION ALL SELECT k, pos + i, 3 + i, t FROM {p}tok, (VALUES (0, 'treinta'), (1, 'y'), (2, 'uno')) s(i, t) WHERE w = '31'
            UNION ALL SELECT k, pos, 6, '31' FROM {p}ahead WHERE w = 'treinta' AND w1 = 'y' AND w2 = 'uno'"""),
        (f"{p}stream", f"SELECT * FROM {p}every WHERE term NOT IN ({stop})"),
    ]


def index_terms(prefix: str = "") -> list[tuple[str, str]]:
    """CTEs from ``stream`` up to ``{prefix}grams(k, pos, term)``."""
    p = prefix
    return [
        (f"{p}runs", f"""SELECT k, pos, term, lead(term, 1) OVER w AS t1, lead(term, 2) OVER w AS t2 FROM {p}stream
            WINDOW w AS (PARTITION BY k ORDER BY pos, ord)"""),
        (f"{p}shingles", f"""SELECT k, pos, term FROM {p}runs UNION ALL
            SELECT k, pos, term || ' ' || t1 FROM {p}runs WHERE t1 IS NOT NULL UNION ALL
            SELECT k, pos, term || ' ' || t1 || ' ' || t2 FROM {p}runs WHERE t2 IS NOT NULL"""),
        (f"{p}grams", f"""SELECT k, pos, left(term, n) AS term FROM
            (SELECT k, pos, term, unnest(range(3, least(15, length(term)) + 1)) AS n FROM {p}shingles) t"""),
    ]


# --- search ----------------------------------------------------------------

def search(texts: str) -> list[tuple[str, str]]:
    """CTEs up to ``total(qstr, id, score)``, per document, from ``texts(qstr)``."""
    tf = "tf / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / mean))"
    return [
        ("docs", "SELECT id, numero_cal, nombre_cal FROM streets"),
        ("texts", texts),
        *entries("docs", "id", "nombre_cal", "d_"),
        *index_terms("d_"),
        ("d_plain", f"""SELECT id AS k, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos
            FROM (SELECT id, {words('lower(nombre_cal)')} AS ws FROM docs) t"""),
        ("occ", """SELECT 'street' AS field, k, term, pos FROM d_grams UNION ALL
            SELECT 'plain', k, term, pos FROM d_plain"""),
        ("lens", "SELECT field, k, count(DISTINCT pos) AS dl FROM occ GROUP BY 1, 2"),
        ("stats", "SELECT field, count(*) AS total, avg(dl) AS mean FROM lens GROUP BY 1"),
        ("posts", "SELECT field, k, term, count(*) AS tf FROM occ GROUP BY 1, 2, 3"),
        ("dfs", "SELECT field, term, count(*) AS n FROM posts GROUP BY 1, 2"),
        ("weighted", f"""SELECT field, k, term, tf, dl, mean, ln(1 + (total - n + 0.5e0) / (n + 0.5e0)) AS idf,
            ln(1 + (total - n + 0.5e0) / (n + 0.5e0)) * {tf} AS weight
            FROM posts JOIN dfs USING (field, term) JOIN lens USING (field, k) JOIN stats USING (field)"""),
        *entries("texts", "qstr", "qstr", "q_"),
        ("q_terms", "SELECT DISTINCT k AS qstr, pos, term FROM q_stream"),
        ("q_plain", f"""SELECT qstr, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos
            FROM (SELECT qstr, {words('lower(qstr)')} AS ws FROM texts) t"""),
        ("need", "SELECT qstr, count(DISTINCT pos) AS need FROM q_terms GROUP BY 1"),
        # phrase
        ("hits", """SELECT q.qstr, o.k, q.term, q.pos, o.pos AS dpos, o.pos - q.pos AS delta
            FROM q_terms q JOIN (SELECT DISTINCT k, term, pos FROM occ WHERE field = 'street') o ON o.term = q.term"""),
        ("covered", """SELECT a.qstr, a.k, a.delta, w FROM (SELECT DISTINCT qstr, k, delta FROM hits) a,
            (VALUES (0), (1), (2), (3)) v(w), hits h, need
            WHERE h.qstr = a.qstr AND h.k = a.k AND h.delta BETWEEN a.delta AND a.delta + w AND need.qstr = a.qstr
            GROUP BY a.qstr, a.k, a.delta, w, need
            HAVING count(DISTINCT h.pos) = need AND count(DISTINCT (h.term, h.dpos)) >= need"""),
        ("widths", "SELECT qstr, k, min(w) AS width FROM covered GROUP BY 1, 2"),
        ("pos_idf", """SELECT h.qstr, h.k, h.pos, max(idf) AS idf, any_value(dl) AS dl, any_value(mean) AS mean
            FROM hits h JOIN weighted w ON w.field = 'street' AND w.k = h.k AND w.term = h.term GROUP BY 1, 2, 3"""),
        ("phrase", """SELECT qstr, k, 5e0 * sum(idf) * (1e0 / (1 + any_value(width)))
            / ((1e0 / (1 + any_value(width))) + 1.2e0 * (0.25e0 + 0.75e0 * any_value(dl) / any_value(mean))) AS score
            FROM pos_idf JOIN widths USING (qstr, k) GROUP BY 1, 2"""),
        # words and beginning
        ("toks", """SELECT *, pos = max(pos) OVER (PARTITION BY field, qstr) AS is_last FROM (
            SELECT 'street' AS field, qstr, pos, term FROM q_terms UNION ALL
            SELECT 'plain', qstr, pos, term FROM q_plain) t"""),
        ("pre", """SELECT field, qstr, k, sum(s) AS score FROM (
            SELECT t.field, t.qstr, w.k, w.weight AS s FROM toks t JOIN weighted w ON w.field = t.field AND w.term = t.term
            WHERE NOT is_last
            UNION ALL
            SELECT DISTINCT t.field, t.qstr, p.k, 1e0 FROM toks t JOIN posts p
              ON p.field = t.field AND starts_with(p.term, t.term) WHERE is_last) x GROUP BY 1, 2, 3"""),
        ("prefix", "SELECT qstr, k, 3e0 * sum(score) AS score FROM pre GROUP BY 1, 2"),
        # fuzzy
        ("vocab", "SELECT DISTINCT term AS found FROM posts WHERE field = 'street'"),
        ("near", """SELECT term, found, damerau_levenshtein(term, found) AS edits
            FROM (SELECT DISTINCT term FROM q_terms) t JOIN vocab ON left(term, 2) = left(found, 2)
            WHERE damerau_levenshtein(term, found)
              <= CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END"""),
        ("fuzzy", """SELECT qstr, k, 1.5e0 * sum(best) AS score FROM (
            SELECT qstr, k, pos, q.term, max(weight * (1 - edits / CAST(least(length(q.term), length(found)) AS DOUBLE))) AS best
            FROM q_terms q JOIN near USING (term) JOIN weighted w ON w.field = 'street' AND w.term = found
            WHERE edits < least(length(q.term), length(found)) GROUP BY 1, 2, 3, 4) x GROUP BY 1, 2"""),
        ("total", """SELECT qstr, k AS id, round(sum(score), 6) AS score FROM (
            SELECT * FROM phrase UNION ALL SELECT * FROM prefix UNION ALL SELECT * FROM fuzzy) x GROUP BY 1, 2"""),
    ]
