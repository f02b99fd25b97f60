"""Parts that the SQL of several queries shares."""

from __future__ import annotations

from tallyloom.operators.statements import ITEMS


def date(c: str) -> str:
    """A date in any of the spellings, as SQL."""
    s = f"trim({c})"
    named = f"try_strptime({s}, ['%d-%b-%Y', '%b %d, %Y', '%m/%d/%Y', '%Y/%m/%d', '%Y%m%d'])"
    return f"CASE WHEN regexp_matches({s}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast({s}[1:10] AS DATE) ELSE try_cast({named} AS DATE) END"


def tag(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim({c})), '^us-gaap[:_]', ''), '[^a-z0-9]', '', 'g')"


def unit(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower({c}), '\\s+', '', 'g'), '(iso4217|xbrli)[:_]', '', 'g'), '-per-', '/')"


def item(c: str) -> str:
    return f"regexp_replace(lower(trim({c})), '[\\s_-]+', '_', 'g')"


FACTS = f"""
facts AS (SELECT entry_id, cik, {tag('tag')} AS tag, {unit('unit')} AS unit, {date('period_start')} AS s, {date('period_end')} AS e, {date('filed')} AS f,
                 coalesce(trim(period_start), '') = '' AS instant, CASE WHEN NOT isnan(val) THEN val END AS val, fy, form FROM fact_entry),
chain AS (SELECT item_key, kind, {unit('unit')} AS unit, {tag('t')} AS tag, place FROM (SELECT item_key, kind, unit, unnest(tags) AS t, generate_subscripts(tags, 1) - 1 AS place FROM tag_spec)),
ok AS (SELECT facts.*, item_key, place FROM facts JOIN chain USING (tag, unit)
       WHERE form IN ('10-K', '10-K/A') AND val IS NOT NULL AND e IS NOT NULL AND f IS NOT NULL AND CASE WHEN kind = 'instant' THEN instant ELSE NOT instant AND e - s BETWEEN 330 AND 400 END),
per AS (SELECT cik, item_key, place, tag, e AS "end", last(val ORDER BY f, entry_id) AS value, first(fy ORDER BY f, entry_id) AS fiscal_year, max(f) AS filed,
               min(f) <> max(f) AND last(val ORDER BY f, entry_id) <> first(val ORDER BY f, entry_id) AS restated FROM ok GROUP BY cik, item_key, place, tag, e),
res AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY cik, item_key, "end" ORDER BY place) = 1)"""

YEARS = """
ends AS (SELECT cik, fiscal_year, max("end") AS "end" FROM res WHERE item_key = 'total_assets' AND fiscal_year IS NOT NULL GROUP BY ALL),
yrs AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY cik ORDER BY "end" DESC, fiscal_year DESC) <= 5)"""

GRID = """
grid AS (SELECT y.cik, i.item_key, y."end", y.fiscal_year, r.value, r.tag, r.restated FROM yrs y CROSS JOIN (SELECT item_key FROM tag_spec) i
         LEFT JOIN res r ON r.cik = y.cik AND r.item_key = i.item_key AND r."end" = y."end")"""

WIDE = "wide AS (SELECT cik, fiscal_year, " + ", ".join(f"max(CASE WHEN item_key = '{i}' THEN value END)::DOUBLE AS {i}" for i in ITEMS) + " FROM grid GROUP BY cik, fiscal_year)"

ALL = f"WITH {FACTS}, {YEARS}, {GRID}, {WIDE}"


def rounding(v: str) -> str:
    cases = " ".join(f"WHEN abs({v} - round_even({v} / {u}, 0) * {u}) <= abs({v}) * 1e-12 THEN {u}" for u in ("1000000.0", "100000.0", "10000.0", "1000.0"))
    return f"CASE WHEN {v} IS NULL OR {v} = 0 THEN 0.0 {cases} ELSE 1.0 END"


def tolerance(terms: list[str]) -> str:
    return "greatest(1.0, " + " + ".join(f"({rounding(t)})" for t in terms) + ")::DOUBLE"
