"""DuckDB SQL twins of ``hatefold.plans.bindings`` (used by the oracle only)."""

from __future__ import annotations

from .bindings import AUX_CROSSWALK, LANG_TARGETS, TALK_WORDS, WORD_TYPES, WORDS
from . import fixed_values as FV


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fine_sql() -> str:
    parts = []
    for j, col in enumerate(FV.FINE_COLS[:7]):
        parts.append(f"CAST(coalesce(contains(lower(d.text), {_q(WORDS[j])}), false) AS INTEGER) AS {col}")
    rest = " OR ".join(f"contains(lower(d.text), {_q(w)})" for w in WORDS[7:])
    parts.append(f"CAST(coalesce({rest}, false) AS INTEGER) AS {FV.FINE_COLS[7]}")
    return ",\n  ".join(parts)


VIEWS = {
    "posts": f"""posts AS (
  SELECT d.doc_id, lower(d.text) AS text,
    CASE WHEN l.toxic = 0 THEN 'clean' WHEN l.quality = 1 THEN 'offensive' ELSE 'hate' END AS hate_label,
    d.source,
  {_fine_sql()}
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    "macro_posts": """macro_posts AS (
  SELECT d.doc_id, d.text AS comment,
    CASE WHEN l.doc_id IS NULL THEN 'unknown'
         WHEN l.toxic = 1 AND l.quality = 0 THEN 'insult'
         WHEN l.toxic = 1 THEN 'hate'
         WHEN l.toxic = 0 THEN 'neutral' END AS macrolabel,
    d.lang AS microlabel
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "lexicon": "lexicon AS (SELECT * FROM (VALUES "
    + ", ".join(f"({_q(w)}, CAST({i} AS BIGINT), [{_q(w)}, {_q(w + 's')}], CAST([] AS VARCHAR[]), "
                f"{_q(WORD_TYPES[i])}, CAST([] AS VARCHAR[]))" for i, w in enumerate(WORDS))
    + ") t(seed, seed_ord, canonical, jamo, type, targets))",
    "lexicon_forms": """lexicon_forms AS (
  SELECT seed, seed_ord, type, CAST(i - 1 AS INTEGER) AS form_ord, canonical[i] AS form
  FROM lexicon, range(1, len(canonical) + 1) r(i)
  WHERE canonical[i] IS NOT NULL AND length(canonical[i]) > 0)""",
    "talk_forms": f"""talk_words AS (
  SELECT term AS seed, row_number() OVER (ORDER BY freq DESC, term) - 1 AS seed_ord FROM (
    SELECT term, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS term FROM conversations)
    WHERE length(term) >= 5 GROUP BY term ORDER BY freq DESC, term LIMIT {TALK_WORDS})),
talk_forms AS (
  SELECT seed, seed_ord, seed AS form FROM talk_words UNION ALL SELECT seed, seed_ord, seed[1:4] FROM talk_words)""",
    "scored": """scored AS (
  SELECT vec_id AS id, CAST(label % 3 AS INTEGER) AS y_coarse,
    list_transform(embedding[12:19], lambda x: CAST(x > 0 AS INTEGER)) AS y_fine,
    list_transform(embedding[1:3], lambda x: CAST(x AS DOUBLE)) AS logits_coarse,
    list_transform(embedding[4:11], lambda x: CAST(x AS DOUBLE)) AS logits_fine,
    label AS y10
  FROM embeddings)""",
    "scored_b": """scored_b AS (
  SELECT vec_id AS id, CAST(label % 3 AS INTEGER) AS y_coarse,
    list_transform(embedding[12:19], lambda x: CAST(x > 0 AS INTEGER)) AS y_fine,
    list_transform(embedding[21:23], lambda x: CAST(x AS DOUBLE)) AS logits_coarse,
    list_transform(embedding[24:31], lambda x: CAST(x AS DOUBLE)) AS logits_fine,
    label AS y10
  FROM embeddings)""",
    "logits10": """logits10 AS (
  SELECT vec_id AS id, label AS y, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS logits
  FROM embeddings)""",
    "history": """history AS (
  SELECT user_id AS run_id,
    CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS epoch,
    max(value) AS metric
  FROM events GROUP BY 1, 2)""",
    "batch_losses": """batch_losses AS (
  SELECT event_type AS run_id,
    CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS epoch,
    value AS loss, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n_rows
  FROM events)""",
}


def aux_crosswalk_values() -> str:
    rows = ", ".join(f"({_q(m)}, {'NULL' if mi is None else _q(mi)}, {_q(t)})" for m, mi, t in AUX_CROSSWALK)
    return f"xwalk AS (SELECT * FROM (VALUES {rows}) t(macro, micro, target))"


def with_views(*names: str, extra: list[str] | None = None) -> str:
    """WITH clause holding the named views (dependencies first)."""
    deps = {"lexicon_forms": ["lexicon"]}
    ordered: list[str] = []

    def add(n):
        for d in deps.get(n, []):
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    parts = [VIEWS[n] for n in ordered] + list(extra or [])
    return "WITH " + ",\n".join(parts) + "\n"


LANG_TARGET_COLS = [t for _, t in LANG_TARGETS]
