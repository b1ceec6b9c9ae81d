"""Relational SQL for the script functions, used only to check them.

One row per token or character and ordinary joins, unlike the string
expressions under test.
"""

from __future__ import annotations

from ..functions import codec, text, translit


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join(
        "(" + ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


_KEYS = sorted([*translit.CONSONANTS, *translit.VOWELS], key=len, reverse=True)
_TOKEN = "(?s)" + "|".join([r"\|\|", *_KEYS, "."])

_TYPED = (
    [(k, "c", v, "") for k, v in translit.CONSONANTS.items()]
    + [(k, "v", v, translit.MATRA_OF[v]) for k, v in translit.VOWELS.items()]
    + [(k, "o", v, "") for k, v in {**translit.SIGNS, **translit.DIGITS, "||": "॥", "|": "।"}.items()]
)

TYPESET = "[a-zA-Z0-9" + "".join("\\" + c if ord(c) < 128 else c for c in text.PUNCTUATION) + "]"


def clean_sql(c: str) -> str:
    barred = f"replace(replace({c}, '||', '॥'), '|', '।')"
    bare = f"translate({barred}, {quoted(text.ZERO_WIDTH)}, '')"
    spaced = f"regexp_replace({bare}, {quoted(TYPESET)}, ' ', 'g')"
    return f"trim(regexp_replace({spaced}, '\\s+', ' ', 'g'))"


_LETTERS = (
    [(c, "c", s) for c, s in codec.CONSONANTS.items()]
    + [(c, "v", s) for c, s in codec.VOWELS.items()]
    + [(c, "m", s) for c, s in codec.MATRAS.items()]
    + [(codec.VIRAMA, "x", "")]
    + [(c, "o", s) for c, s in {**codec.SIGNS, **codec.PUNCTUATION, **codec.DIGITS}.items()]
)

VIEWS = {
    "typed_tokens": ([], f"""
        SELECT d.doc_id, d.pos, d.tok, t.kind, t.letter, t.matra,
               lead(d.tok) OVER w AS next_tok, lag(t.kind) OVER w AS prev_kind,
               lead(t.kind) OVER w AS next_kind
        FROM (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (
                SELECT doc_id, regexp_extract_all(text, {quoted(_TOKEN)}) AS toks FROM documents)) d
        LEFT JOIN ({values(_TYPED)}) t(tok, kind, letter, matra) ON t.tok = d.tok
        WINDOW w AS (PARTITION BY d.doc_id ORDER BY d.pos)"""),
    "typed": (["typed_tokens"], f"""
        SELECT d.doc_id, d.lang, coalesce(k.out, '') AS out FROM documents d LEFT JOIN (
          SELECT doc_id, string_agg(CASE
              WHEN kind = 'c' AND coalesce(next_kind, '') <> 'v' THEN letter || '{translit.VIRAMA}'
              WHEN kind = 'c' THEN letter
              WHEN kind = 'v' AND prev_kind = 'c' THEN matra
              WHEN tok = '{translit.BARE_MARK}' AND prev_kind = 'c' THEN ''
              WHEN kind IS NOT NULL THEN letter
              ELSE tok END, '' ORDER BY pos) AS out
          FROM typed_tokens GROUP BY doc_id) k USING (doc_id)"""),
    "kannada": (["typed"], f"SELECT doc_id, lang, {clean_sql('out')} AS kn FROM typed"),
    "letters": (["kannada"], f"""
        SELECT d.*, t.kind, t.symbol, lead(t.kind) OVER w AS next_kind, lag(t.kind) OVER w AS prev_kind
        FROM (SELECT doc_id, unnest(cs) AS ch, generate_subscripts(cs, 1) AS pos FROM (
                SELECT doc_id, string_split(kn, '') AS cs FROM kannada WHERE kn <> '')) d
        LEFT JOIN ({values(_LETTERS)}) t(ch, kind, symbol) ON t.ch = d.ch
        WINDOW w AS (PARTITION BY d.doc_id ORDER BY d.pos)"""),
    "symbols": (["letters"], f"""
        SELECT k.doc_id, k.lang, k.kn, CASE WHEN k.kn = '' THEN '' WHEN s.ok THEN s.syms END AS syms,
               coalesce(s.digits, 0) AS digits
        FROM kannada k LEFT JOIN (
          SELECT doc_id, bool_and(kind IS NOT NULL AND NOT (kind IN ('m', 'x') AND coalesce(prev_kind, '') <> 'c')) AS ok,
                 count(*) FILTER (WHERE symbol LIKE '#%') AS digits,
                 string_agg(CASE WHEN kind = 'x' THEN NULL
                                 WHEN kind = 'c' AND coalesce(next_kind, '') NOT IN ('m', 'x')
                                 THEN symbol || '|{codec.INHERENT_VOWEL}' ELSE symbol END, '|' ORDER BY pos) AS syms
          FROM letters GROUP BY doc_id) s USING (doc_id)"""),
}
