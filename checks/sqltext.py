"""Shared pieces of the oracle SQL: the derived inputs as common table expressions."""

from __future__ import annotations

from lectern.functions import fixed

WS = f"'{fixed.WHITESPACE}'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean(expr: str) -> str:
    return f"trim(coalesce({expr}, ''), {WS})"


CORPUS = "(['eli5', 'sciq', 'openbookqa', 'wikihow', 'other'])[{} % 5 + 1]"

CTES = {
    "chat": """
        SELECT CAST(conv_id AS VARCHAR) AS key, conv_id,
               list({'role': role, 'content': text} ORDER BY turn) AS messages
        FROM conversations GROUP BY conv_id""",
    "faulty": """
        SELECT key, conv_id, CASE WHEN conv_id % 6 <> 0 THEN list_transform(messages, lambda m, i: {
            'role': CASE WHEN i = 1 AND conv_id % 6 = 1 THEN 'tool'
                         WHEN i = 1 AND conv_id % 6 = 3 THEN NULL ELSE m.role END,
            'content': CASE WHEN i = 1 AND conv_id % 6 = 2 THEN ''
                            WHEN i = 1 AND conv_id % 6 = 3 THEN NULL ELSE m.content END}) END AS messages
        FROM chat""",
    "exchanges": f"""
        SELECT u.conv_id, u.turn, u.conv_id || '-' || u.turn AS key,
               {CORPUS.format('u.conv_id')} AS corpus,
               u.text AS question, a.text AS answer, p.text AS context
        FROM conversations u
        LEFT JOIN conversations a
               ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
        LEFT JOIN conversations p ON p.conv_id = u.conv_id AND p.turn = u.turn - 1
        WHERE u.role = 'user'""",
    "qa": "SELECT * FROM exchanges WHERE answer IS NOT NULL",
    "texts": """
        SELECT key, conv_id, messages,
               list_transform(list_filter(messages, lambda m: m.role = 'user'), lambda m: m.content) AS user_texts,
               list_transform(list_filter(messages, lambda m: m.role = 'system'), lambda m: m.content) AS system_texts,
               list_transform(list_filter(messages, lambda m: m.role = 'assistant'), lambda m: m.content) AS texts
        FROM chat""",
    "scored": """
        SELECT key, user_texts[1] AS title, system_texts[1] AS selftext, texts,
               CASE WHEN conv_id % 5 = 0 THEN list_transform(texts, lambda t: length(t) % 7)[:-2]
                    ELSE list_transform(texts, lambda t: length(t) % 7) END AS scores
        FROM texts""",
    "best": """
        SELECT *, coalesce(CASE WHEN len(scores) > 0 AND len(scores) = len(texts)
                                THEN texts[list_position(scores, list_max(scores))]
                                ELSE texts[1] END, '') AS best
        FROM scored""",
    "keyed": """
        SELECT key, question_stem, fact1, labels, choice_texts,
               coalesce(labels[conv_id % (len(labels) + 1) + 1], '?') AS answer_key
        FROM (SELECT key, conv_id, user_texts[1] AS question_stem, system_texts[1] AS fact1,
                     list_transform(messages, lambda m: m.content) AS choice_texts,
                     list_transform(messages, lambda m, i: CASE WHEN conv_id % 7 = 0 AND i = 3 THEN 'A'
                         ELSE chr(CAST(65 + (i - 1) % 26 AS INTEGER))
                              || CASE WHEN i > 26 THEN CAST((i - 1) // 26 AS VARCHAR) ELSE '' END END) AS labels
              FROM texts)""",
    "chosen": """
        SELECT *, coalesce(list_filter(choice_texts, lambda t, i: labels[i] = answer_key)[-1], '') AS choice
        FROM keyed""",
    "docs": "SELECT *, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END AS output FROM documents",
    "slides": f"""
        SELECT 'deck' || (doc_id // 12) AS deck, doc_id % 12 + 1 AS slide_number, doc_id,
               trim(array_to_string(list_filter(string_split(text, chr(10)), lambda t: t <> ''), chr(10)), {WS}) AS text_content,
               doc_id % 2 = 0 AS has_table, source, lang, n_chars,
               CASE WHEN lang <> 'en' THEN lang END AS notes
        FROM documents""",
    "images": """
        SELECT 'deck' || (doc_id // 12) AS deck, doc_id % 12 + 1 AS slide_number, ordinal,
               CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'img/' || md5(text) || '-' || ordinal END AS image_path
        FROM documents, (VALUES (0), (1)) o(ordinal)
        WHERE ordinal < doc_id % 3""",
    "stored": """
        SELECT lang AS deck, sha1(text) AS sha1, min(doc_id + 1) AS first_slide
        FROM documents GROUP BY lang, sha1(text)""",
    "quiz_raw": r"""
        SELECT doc_id, lang, text, source, CASE doc_id % 6
            WHEN 0 THEN '[' || item || ', ' || item || ']'
            WHEN 1 THEN 'Here [it] is:' || chr(10) || '```json' || chr(10) || '[' || item || ']' || chr(10) || '```'
                        || CASE WHEN source = 'src7' THEN ' [end]' ELSE '' END
            WHEN 2 THEN '[' || item
            WHEN 3 THEN item
            WHEN 4 THEN '[' || item || ', {"question": "' || lang || '", "options": []}]'
            ELSE '[]' END AS raw
        FROM (SELECT *, '{"question": "' || regexp_replace(text, '["\\\x00-\x1f]', ' ', 'g')
              || '", "options": ["A. ' || lang || '", "B. ' || source || '", "C. both"'
              || CASE WHEN doc_id % 4 = 0 THEN ', "D. none"' ELSE '' END
              || '], "correct_index": ' || (doc_id % 5)
              || CASE WHEN doc_id % 9 = 0 THEN ', "rationale": null}'
                      ELSE ', "rationale": "see ' || source || '"}' END AS item
              FROM documents)""",
    "quiz_json": r"""
        SELECT *, CASE WHEN json_valid(raw) THEN raw
                       WHEN json_valid(regexp_extract(raw, '(?s)```json.*?(\[.*\])', 1))
                       THEN regexp_extract(raw, '(?s)```json.*?(\[.*\])', 1) END AS j
        FROM quiz_raw""",
    "quiz_list": """
        SELECT *, CASE WHEN json_type(j) = 'ARRAY' THEN from_json(j, '["JSON"]') END AS parsed FROM quiz_json""",
    "quiz": """
        SELECT *, CASE WHEN parsed IS NULL THEN 'Failed to parse questions JSON'
                       WHEN len(list_filter(parsed, lambda q: json_type(q) <> 'OBJECT'
                            OR NOT list_has_all(json_keys(q), ['question', 'options', 'correct_index', 'rationale']))) > 0
                       THEN 'Invalid question structure' END AS error
        FROM quiz_list""",
    "questions": """
        SELECT doc_id, lang, number,
               json_extract_string(q, '$.question') AS question,
               from_json(json_extract(q, '$.options'), '["VARCHAR"]') AS options,
               CAST(json_extract(q, '$.correct_index') AS INTEGER) AS correct_index,
               json_extract_string(q, '$.rationale') AS rationale
        FROM (SELECT doc_id, lang, unnest(parsed) AS q, generate_subscripts(parsed, 1) AS number
              FROM quiz WHERE error IS NULL)""",
    "pairs": """
        SELECT key, corpus, CASE WHEN corpus = 'other' THEN question ELSE answer END AS hyp, question AS ref
        FROM qa""",
    "log": """
        SELECT CAST(user_id AS VARCHAR) AS session, ts, event_id AS id, props AS response,
               CASE event_type WHEN 'signup' THEN 'upload' WHEN 'view' THEN 'explain'
                    WHEN 'click' THEN 'next' WHEN 'error' THEN 'prev'
                    ELSE (['analogy', 'example', 'quiz'])[event_id % 3 + 1] END AS action
        FROM events""",
    "segments": """
        SELECT *, CAST(sum(CASE WHEN action = 'upload' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS segment,
               row_number() OVER w AS rn
        FROM log WINDOW w AS (PARTITION BY session ORDER BY ts, id ROWS UNBOUNDED PRECEDING)""",
    "explained": """
        SELECT *, coalesce(last_value(CASE WHEN action = 'upload' THEN ''
                                           WHEN action = 'explain' AND segment > 0 THEN response END IGNORE NULLS)
                  OVER (PARTITION BY session ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')
               AS last_explanation
        FROM segments""",
    "gated": f"""
        SELECT *, CASE WHEN action = 'explain' AND segment = 0 THEN {quoted(fixed.UPLOAD_FIRST)}
                       WHEN action IN ('analogy', 'example', 'quiz') AND last_explanation = ''
                       THEN {quoted(fixed.EXPLAIN_FIRST)} END AS message
        FROM explained""",
    "steps": """
        SELECT session, id, rn, CASE WHEN action = 'next' THEN 1 ELSE 0 END AS slide_idx
        FROM segments WHERE rn = 1
        UNION ALL
        SELECT s.session, s.id, s.rn,
               CASE s.action WHEN 'upload' THEN 0 WHEN 'next' THEN least(4, p.slide_idx + 1)
                    WHEN 'prev' THEN greatest(0, p.slide_idx - 1) ELSE p.slide_idx END
        FROM steps p JOIN segments s ON s.session = p.session AND s.rn = p.rn + 1""",
    "train": """
        SELECT user_id AS run, event_id AS step,
               CASE WHEN event_type = 'view' THEN value / 100 END AS eval_loss
        FROM events""",
}

NEEDS = {
    "faulty": ["chat"],
    "qa": ["exchanges"],
    "texts": ["chat"],
    "scored": ["texts"],
    "best": ["scored"],
    "keyed": ["texts"],
    "chosen": ["keyed"],
    "quiz_json": ["quiz_raw"],
    "quiz_list": ["quiz_json"],
    "quiz": ["quiz_list"],
    "questions": ["quiz"],
    "pairs": ["qa"],
    "segments": ["log"],
    "explained": ["segments"],
    "gated": ["explained"],
    "steps": ["segments"],
}


def with_inputs(names: str, body: str) -> str:
    """``body`` behind the named inputs and those they are built from."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    parts = ", ".join(f"{n} AS ({CTES[n]})" for n in ordered)
    return f"WITH RECURSIVE {parts} {body}" if "steps" in ordered else f"WITH {parts} {body}"


FLAT = (
    "array_to_string(list_transform({0}, lambda m: coalesce(m.role, '?') || '=' || "
    "coalesce(m.content, '?')), '|')"
)
