"""SQL forms of the catalogue queries' building blocks, for checking results with another engine."""

from __future__ import annotations

from ..functions import vocab
from .search_plan import Filters, Subquery, fetch_size


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(items) -> str:
    return "[" + ", ".join(text(i) for i in items) + "]"


def mapping(words: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in words.items()) + "}"


SPACE = r"[\s\x{00A0}]"


def tokens(col: str) -> str:
    return rf"list_transform(regexp_split_to_array({col}, '[\s\x{{00A0}}\-_/\x{{2010}}-\x{{2015}}]+'), lambda t: regexp_replace(lower(t), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'))"


def first_value(words: str, table: dict[str, list[str]]) -> str:
    return f"list_filter(list_transform({words}, lambda w: {mapping(vocab.lookup(table))}[w]), lambda v: v IS NOT NULL)[1]"


def gender(col: str) -> str:
    return first_value(f"list_transform({tokens(col)}, lambda t: regexp_replace(t, '''s?$', ''))", vocab.GENDERS)


def category(col: str) -> str:
    return f"CASE WHEN contains(lower({col}), 't-shirt') OR contains(lower({col}), 't shirt') OR contains(lower({col}), ' tee') THEN 't-shirt' ELSE {first_value(tokens(col), vocab.CATEGORIES)} END"


def color(col: str) -> str:
    return f"CASE WHEN contains(lower({col}), 'navy blue') OR contains(lower({col}), 'navy-blue') THEN 'navy' ELSE {first_value(tokens(col), vocab.COLORS)} END"


def size(col: str) -> str:
    has = lambda names: " OR ".join(f"contains(lower({col}), {text(n)})" for n in names)
    told = rf"lower(regexp_extract({col}, '(?i)\bsize{SPACE}*[:\-]?{SPACE}*([a-z0-9]+)\b', 1))"
    return (
        f"CASE WHEN {has(['extra-large', 'extra large', 'x-large'])} THEN 'xl' WHEN {has(['extra-small', 'extra small', 'x-small'])} THEN 'xs' "
        f"ELSE coalesce({mapping(vocab.lookup(vocab.SIZES))}[{told}], {first_value(tokens(col), vocab.SIZES)}) END"
    )


def style(col: str) -> str:
    return first_value(tokens(col), vocab.STYLES)


ATTRIBUTES = {"gender": gender, "category": category, "color": color, "style": style, "size": size}

PRODUCTS = """products AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent_asin
  ORDER BY rating_number DESC NULLS LAST, price DESC NULLS LAST, title ASC NULLS LAST) AS n FROM metadata WHERE parent_asin IS NOT NULL) WHERE n = 1)"""
REVIEWS = "rev AS (SELECT DISTINCT review_id, parent_asin, rating, title, text, ts, verified_purchase, helpful_vote FROM reviews WHERE review_id IS NOT NULL)"
INDEX = """cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id
  ORDER BY indexed_at DESC NULLS LAST, title DESC NULLS LAST, rating_number DESC NULLS LAST, average_rating DESC NULLS LAST) AS n FROM vector_index WHERE id IS NOT NULL) WHERE n = 1)"""
ASPECTS = f"len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pN_]+'), lambda x: list_contains({values(vocab.ASPECTS)}, x)))"
SENTIMENT = "CASE WHEN round(rating) IN (1, 2) THEN 'negative' WHEN round(rating) = 3 THEN 'neutral' WHEN round(rating) IN (4, 5) THEN 'positive' ELSE 'neutral' END"
BUCKET = "CASE WHEN rating BETWEEN 0 AND 2.5 THEN 'low' WHEN rating > 2.5 AND rating <= 3.5 THEN 'middle' WHEN rating > 3.5 AND rating <= 5 THEN 'high' END"
SCORED = f"""{REVIEWS}, scored AS (SELECT review_id, parent_asin, rating, {BUCKET} AS bucket, {SENTIMENT} AS sentiment,
  round(ln(1 + coalesce(helpful_vote, 0)::DOUBLE) + 0.5 * coalesce(verified_purchase, false)::INT + 0.2 * least({ASPECTS}, 4)
    + 0.5 * least(length(coalesce(text, '')), 400) / 400.0 - 0.5 * (length(coalesce(text, '')) > 1500)::INT
    + 0.3::DOUBLE / (1 + greatest(floor((1693526400000 - coalesce(ts, 1693526400000)) / 86400000.0), 0) / 365.0), 6) AS score FROM rev)"""
KEPT = f"""{SCORED}, cnt AS (SELECT parent_asin, count(rating) AS n_rated FROM scored WHERE parent_asin IS NOT NULL GROUP BY 1),
kept AS (SELECT s.*, n_rated, CASE WHEN n_rated <= 3 THEN n_rated WHEN n_rated <= 10 THEN 2 ELSE 3 END AS keep FROM (
  SELECT *, row_number() OVER (PARTITION BY parent_asin, bucket ORDER BY score DESC, review_id) AS place FROM scored WHERE parent_asin IS NOT NULL AND bucket IS NOT NULL) s
  JOIN cnt USING (parent_asin) WHERE place <= CASE WHEN n_rated <= 3 THEN n_rated WHEN n_rated <= 10 THEN 2 ELSE 3 END)"""
MAJORITY = """majority AS (SELECT parent_asin, sentiment AS overall_sentiment FROM (SELECT parent_asin, sentiment,
  row_number() OVER (PARTITION BY parent_asin ORDER BY count(*) DESC, sentiment) AS r FROM kept GROUP BY 1, 2) WHERE r = 1)"""
HIGHLIGHTS = """txt AS (SELECT kept.*, coalesce(t.text, '') AS body FROM kept JOIN (SELECT DISTINCT review_id, text FROM rev) t USING (review_id)),
lists AS (SELECT parent_asin, count(*) AS total,
  coalesce(list(body ORDER BY score DESC, review_id) FILTER (sentiment = 'positive'), []) AS p,
  coalesce(list(body ORDER BY score DESC, review_id) FILTER (sentiment = 'neutral'), []) AS u,
  coalesce(list(body ORDER BY score DESC, review_id) FILTER (sentiment = 'negative'), []) AS g FROM txt GROUP BY 1),
quota AS (SELECT *, greatest(1, round(0.6 * total))::INT AS qp, round(0.2 * total)::INT AS qu, round(0.2 * total)::INT AS qg FROM lists),
mixed AS (SELECT parent_asin, list_concat(list_concat(
  p[1:qp + greatest(qp - len(p), 0) + greatest(qu - len(u), 0) + greatest(qg - len(g), 0)], CASE WHEN qu > 0 THEN u[1:qu] ELSE [] END), CASE WHEN qg > 0 THEN g[1:qg] ELSE [] END) AS review_highlights FROM quota)"""
DESCRIPTION = "nullif(array_to_string(list_filter(list_transform(description, lambda x: trim(x)), lambda x: x <> ''), ' '), '')"


def footwear(cat: str, title: str) -> str:
    return f"(lower(coalesce({cat}, '')) IN ('shoes', 'sneakers') OR regexp_matches(coalesce({title}, ''), {text('(?i)' + vocab.FOOTWEAR_PATTERN)}))"


def accessory(cat: str, title: str) -> str:
    return f"(NOT {footwear(cat, title)} AND (lower(coalesce({cat}, '')) IN ('hat', 'cap') OR regexp_matches(coalesce({title}, ''), {text('(?i)' + vocab.ACCESSORY_PATTERN)})))"


def effective_gender(g: str, cat: str, title: str) -> str:
    return f"coalesce(CASE WHEN lower({g}) IN ('men', 'women', 'kids', 'unisex') THEN lower({g}) END, {gender(title)}, CASE WHEN coalesce(nullif({cat}, ''), {category(title)}) IN ('dress', 'skirt', 'blouse') THEN 'women' END)"


def region(cat: str, title: str) -> str:
    return f"{mapping(vocab.lookup(vocab.GARMENT_REGIONS))}[lower(coalesce(nullif({cat}, ''), {category(title)}))]"


def image_urls(col: str) -> str:
    pick = lambda test: f"list_filter({col}, lambda i: {test})[1]"
    code = "upper(trim(coalesce(i.variant, '')))"
    slots = [f"coalesce({pick(f'{code} = ' + text('MAIN'))}, {col}[1])", pick(f"{code} = 'PT01'")]
    slots += [pick(f"regexp_matches({code}, {text('^(' + '|'.join(s.upper() for s in starts) + ')')})") for starts in vocab.IMAGE_ANGLES.values()]
    urls = f"list_filter(list_transform([{', '.join(slots)}], lambda i: coalesce(nullif(i.large, ''), nullif(i.hi_res, ''), nullif(i.thumb, ''))), lambda u: u IS NOT NULL)"
    return f"coalesce(list_filter({urls}, lambda u, k: list_position({urls}, u) = k), [])"


def score(query: list[float]) -> str:
    return f"round(list_dot_product(vec::DOUBLE[], {list(query)}::DOUBLE[]), 6)"


def hard(f: Filters) -> str:
    tests = ["true"]
    if f.gender is not None:
        tests.append(f"gender = {text(f.gender)}")
    elif f.exclude_genders:
        tests.append(f"(gender IS NULL OR gender NOT IN ({', '.join(map(text, f.exclude_genders))}))")
    if f.category is not None:
        tests.append(f"category = {text(f.category)}")
    elif f.categories:
        tests.append(f"category IN ({', '.join(map(text, f.categories))})")
    return " AND ".join(tests)


def soft(f: Filters, name: str) -> str:
    v = getattr(f, name)
    if name == "min_rating":
        return f"coalesce(average_rating >= {v}, false)"
    return f"coalesce({'overall_sentiment' if name == 'sentiment' else name} = {text(v)}, false)"


def relaxed(plan: list[Subquery], query: list[float], all_at_once: bool, limits: dict[int, int] | None = None) -> str:
    """CTEs ending in ``relaxed`` (columns of cur, sq_id, chosen, score, rank)."""
    limits = limits or {p.number: fetch_size(p.group) for p in plan}
    parts, steps = [], []
    for p in plan:
        names = p.filters.soft()
        level = "0" if not names else "greatest(" + ", ".join(f"CASE WHEN {soft(p.filters, n)} THEN 0 ELSE {1 if all_at_once else i} END" for i, n in enumerate(names, 1)) + ")"
        parts.append(f"SELECT cur.*, {p.number} AS sq_id, {level} AS level, {score(query)} AS score FROM cur WHERE {hard(p.filters)}")
        last = p.filters.steps(all_at_once)
        steps += [f"({p.number}, {u}, {limits[p.number]}, {last})" for u in range(last + 1)]
    return f"""{INDEX}, cand AS ({' UNION ALL '.join(parts)}),
steps(sq_id, upto, k, last) AS (VALUES {', '.join(steps)}),
have AS (SELECT steps.*, (SELECT count(*) FROM cand WHERE cand.sq_id = steps.sq_id AND cand.level <= steps.upto) AS n FROM steps),
chosen AS (SELECT sq_id, k, min(upto) AS chosen FROM have WHERE least(n, k) >= 5 OR upto = last GROUP BY 1, 2),
relaxed AS (SELECT * FROM (SELECT cand.*, chosen, k, row_number() OVER (PARTITION BY cand.sq_id ORDER BY score DESC, id) AS rank FROM cand JOIN chosen USING (sq_id) WHERE level <= chosen) WHERE rank <= k)"""
