"""SQL fragments shared by the statements (DuckDB dialect, RE2 patterns)."""

from lectern.functions import text as T

WS = T.WS_LIST
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
STUDY_STOP = ", ".join(f"'{w}'" for w in T.STUDY_STOP_WORDS)

LINES = """lines AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS line
  FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS parts
        FROM documents) d, unnest(range(1, len(parts) + 1)) AS r(i))"""


def squeeze(expr: str) -> str:
    return f"regexp_replace({expr}, '{WS}+', ' ', 'g')"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def count_matches(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, '{pattern}'))"


def sentences(source: str = "documents", key: str = "doc_id", column: str = "text") -> str:
    """CTEs ``raw_sentences`` (all pieces) and ``sentences`` (20 characters or more, renumbered)."""
    marked = f"regexp_replace({squeeze(column)}, '([.!?]) ([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g')"
    return f"""raw_sentences AS (
  SELECT {key}, i AS piece, trim(parts[i], ' ') AS sentence
  FROM (SELECT {key}, string_split({marked}, chr(1)) AS parts FROM {source}) d,
       unnest(range(1, len(parts) + 1)) AS r(i)),
sentences AS (
  SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY piece) - 1 AS INTEGER) AS sent_no, sentence
  FROM raw_sentences WHERE length(sentence) >= 20)"""


TOKENS = f"""tokens AS (
  SELECT doc_id, sent_no, i AS tok_no, words[i] AS word, lower(words[i]) AS low
  FROM (SELECT doc_id, sent_no, regexp_extract_all(sentence, '{T.WORD.replace("'", "''")}') AS words
        FROM sentences) s, unnest(range(1, len(words) + 1)) AS r(i))"""

POS_TAG = f"""CASE WHEN regexp_matches(word, '{T.NUMBER}') THEN 'CD'
  WHEN regexp_matches(word, '^[A-Z]') THEN 'NNP'
  WHEN low LIKE '%ing' THEN 'VBG' WHEN low LIKE '%ed' OR low LIKE '%en' THEN 'VBN' WHEN low LIKE '%ly' THEN 'RB'
  WHEN regexp_matches(low, '(al|ive|ous|ful|less|ic|able|ible|ent|ant)$') THEN 'JJ'
  WHEN low LIKE '%s' AND length(low) > 3 THEN 'NNS'
  WHEN low IN ({", ".join(f"'{w}'" for w in T.PREPOSITIONS)}) THEN 'IN'
  WHEN low IN ({STOP}) THEN 'DT' ELSE 'NN' END"""

CONTENT_TOKENS = f"""content AS (
  SELECT *, {POS_TAG} AS pos, row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY tok_no) AS c_no
  FROM tokens WHERE low NOT IN ({STOP}) AND NOT regexp_matches(word, '{T.NUMBER}') AND length(low) >= 3)"""
