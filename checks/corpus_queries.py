"""Sources, text functions, sampling, chat records and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs
from checks.registry import flat_messages, query
from checks.sqltext import CORPUS, FLAT, clean, quoted, with_inputs
from lectern.functions import fixed
from lectern.functions.text import best_answer, clean_text, lookup_choice, preview, truncate_at_stop
from lectern.operators import chat, sampling
from lectern.operators.decks import only_decks
from lectern.operators.hooks import back_translate
from lectern.plans import prepare as plans
from lectern.session import fresh_path
from lectern.sources import jsonl, qa

QA = "key", "corpus", "question", "answer"


def _kept(columns: str, source: str) -> str:
    return f"SELECT * FROM (SELECT {columns} FROM {source}) t WHERE question <> '' AND answer <> ''"


# --- sources -------------------------------------------------------------------------


@query(
    "qa_from_scored_answers",
    with_inputs(
        "best",
        _kept(
            f"key, 'eli5' AS corpus, {clean('title')} AS question, {clean('best')} AS answer, "
            f"{clean('selftext')} AS context",
            "best",
        ),
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return qa.qa_from_scored_answers(inputs.scored(spark, folder)).select(*QA, "context")


@query(
    "qa_from_pairs",
    with_inputs(
        "exchanges",
        _kept(
            f"key, 'eli5' AS corpus, {clean('question')} AS question, {clean('answer')} AS answer, "
            "'' AS context",
            "exchanges",
        ),
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return qa.qa_from_pairs(inputs.pairs(spark, folder), "eli5").select(*QA, "context")


@query(
    "qa_from_flat",
    with_inputs(
        "exchanges",
        _kept(
            f"key, 'eli5' AS corpus, {clean('question')} AS question, {clean('answer')} AS answer, "
            f"{clean('context')} AS context",
            "exchanges",
        ),
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return qa.qa_from_flat(inputs.flat(spark, folder)).select(*QA, "context")


@query(
    "qa_from_distractors",
    with_inputs(
        "exchanges",
        _kept(
            f"key, 'sciq' AS corpus, {clean('question')} AS question, {clean('answer')} AS answer, "
            f"{clean('context')} AS support, "
            "coalesce(context, '') || '|' || '|' || ' ' || question AS distractors",
            "exchanges",
        ),
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = qa.qa_from_distractors(inputs.distractors(spark, folder))
    return rows.select(*QA, "support", F.array_join("distractors", "|").alias("distractors"))


@query(
    "qa_from_keyed_choices",
    with_inputs(
        "chosen",
        _kept(
            f"key, 'openbookqa' AS corpus, {clean('question_stem')} AS question, "
            f"{clean('choice')} AS answer, {clean('fact1')} AS fact, "
            "array_to_string(choice_texts, '|') AS all_choices",
            "chosen",
        ),
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = qa.qa_from_keyed_choices(inputs.keyed(spark, folder))
    return rows.select(*QA, "fact", F.array_join("all_choices", "|").alias("all_choices"))


ARTICLES = f"""
SELECT * FROM (
  SELECT CAST(doc_id AS VARCHAR) AS key, 'wikihow' AS corpus,
         'Explain how to ' || CASE WHEN doc_id % 4 <> 0 THEN source || ' in ' || lang ELSE 'How to do it' END AS question,
         {clean("CASE WHEN doc_id % 3 = 1 THEN lang || ' ' || text ELSE text END")} AS answer
  FROM documents) t WHERE question <> '' AND answer <> ''"""


@query("qa_from_articles", ARTICLES)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return qa.qa_from_articles(inputs.articles(spark, folder)).select(*QA)


@query(
    "chat_jsonl_records",
    """SELECT event_id, event_id AS id,
              CASE WHEN event_type = 'error' THEN 'tool' ELSE 'user' END || '=' || event_type || ' |assistant=event '
              || event_id AS messages
       FROM events WHERE event_id % 5 = 0""",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    lines = inputs.jsonl_lines(spark, folder).drop("ts")
    records = jsonl.parse_chat_lines(lines).records
    field = F.get_json_object("record", "$.id").cast("long")
    return records.select("event_id", field.alias("id"), flat_messages().alias("messages"))


@query(
    "chat_jsonl_reject_counts",
    """SELECT CASE event_id % 5 WHEN 1 THEN 'not JSON' WHEN 2 THEN 'no messages key'
              ELSE 'not an object' END AS reason, count(*) AS lines
       FROM events WHERE event_id % 5 IN (1, 2, 3) GROUP BY 1""",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return jsonl.reject_counts(jsonl.parse_chat_lines(inputs.jsonl_lines(spark, folder)).rejects)


@query(
    "chat_jsonl_round_trip",
    with_inputs(
        "chat",
        f"""SELECT CASE WHEN conv_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split,
                   {FLAT.format('messages')} AS messages FROM chat""",
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    """Two splits written as JSON lines and read back strictly."""
    records = inputs.chat(spark, folder)
    path = fresh_path(spark, "round-trip")
    is_val = F.col("conv_id") % 5 == 0
    jsonl.write_chat_jsonl(records.filter(~is_val), f"{path}/train.jsonl", {"seed": 42})
    jsonl.write_chat_jsonl(records.filter(is_val), f"{path}/val.jsonl")
    splits = jsonl.read_chat_splits(spark, f"{path}/train.jsonl", f"{path}/val.jsonl")
    return sampling.concat_sets(
        *[
            df.select(F.lit(name).alias("split"), flat_messages().alias("messages"))
            for name, df in splits.items()
        ]
    )


LENGTHS = """count(*) AS total,
    round(coalesce(sum(uc) / nullif(sum(un), 0), 0), 6) AS avg_user_len,
    round(coalesce(sum(ac) / nullif(sum(an), 0), 0), 6) AS avg_assistant_len"""
SIZES = """
    len(list_filter(messages, lambda m: m.role = 'user')) AS un,
    len(list_filter(messages, lambda m: m.role = 'assistant')) AS an,
    list_sum(list_transform(list_filter(messages, lambda m: m.role = 'user'), lambda m: length(m.content))) AS uc,
    list_sum(list_transform(list_filter(messages, lambda m: m.role = 'assistant'), lambda m: length(m.content))) AS ac"""
PREPARED = f"""
    SELECT key, corpus, CASE corpus
        WHEN 'eli5' THEN 'Question: ' || question || chr(10) || chr(10) || 'Context: ' || coalesce(context, '')
            || chr(10) || chr(10) || 'Provide a clear, detailed explanation suitable for someone learning this topic.'
        WHEN 'sciq' THEN 'Science Question: ' || question || chr(10) || chr(10) || 'Supporting information: '
            || coalesce(context, '') || chr(10) || chr(10) || 'Explain the answer clearly.'
        WHEN 'openbookqa' THEN 'Question: ' || question || chr(10) || chr(10) || 'Relevant fact: '
            || coalesce(context, '') || chr(10) || chr(10) || 'Provide a clear explanation of the correct answer.'
        WHEN 'wikihow' THEN 'Question: ' || question || chr(10) || chr(10) || 'Provide a step-by-step explanation.'
        ELSE 'Question: ' || question END AS user_turn, {clean('answer')} AS reply FROM qa"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def _sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    rows = inputs.qa(spark, folder)
    return {c: rows.filter(F.col("corpus") == c) for c in inputs.CORPORA}


@query(
    "prepare_corpora",
    with_inputs(
        "qa",
        f"""SELECT corpus, count(*) AS total, round(avg(length(user_turn)), 6) AS avg_user_len,
                   round(avg(length(reply)), 6) AS avg_assistant_len,
                   (SELECT CAST(floor(count(*) * 0.95) AS BIGINT) FROM qa) AS train,
                   (SELECT count(*) - CAST(floor(count(*) * 0.95) AS BIGINT) FROM qa) AS val
            FROM ({PREPARED}) GROUP BY corpus""",
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    """Corpora written as training files; the statistics counted again from the files."""
    out = fresh_path(spark, "prepare")
    plans.run_prepare(_sources(spark, folder), out)
    splits = jsonl.read_chat_splits(
        spark, f"{out}/combined_train.jsonl", f"{out}/combined_val.jsonl"
    )
    records = [
        jsonl.read_chat_jsonl(spark, f"{out}/{c}_instructions.jsonl").records.withColumn(
            "corpus", F.lit(c)
        )
        for c in inputs.CORPORA
    ]
    count = {name: df.agg(F.count("*")).scalar() for name, df in splits.items()}
    return _rounded(chat.length_stats(sampling.concat_sets(*records), "corpus")).select(
        "*", count["train"].alias("train"), count["validation"].alias("val")
    )


@query(
    "prepared_statistics_document",
    with_inputs(
        "qa",
        f"""SELECT corpus, count(*) AS total, round(avg(length(user_turn)), 6) AS avg_user_len,
                   (SELECT CAST(floor(count(*) * 0.95) AS BIGINT) FROM qa) AS train
            FROM ({PREPARED}) GROUP BY corpus""",
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics as a JSON document, written and read back."""
    split = sampling.exact_split(plans.prepare(_sources(spark, folder)))
    path = fresh_path(spark, "stats")
    jsonl.write_stats(plans.prepare_stats(split, inputs.CORPORA), path)

    def of(name: str, kind: str) -> Column:
        return F.get_json_object("value", f"$.{name}").cast(kind)

    parts = [
        F.struct(
            F.lit(c).alias("corpus"),
            of(f"{c}.total", "long").alias("total"),
            F.round(of(f"{c}.avg_user_len", "double"), 6).alias("avg_user_len"),
            of("combined.train.count", "long").alias("train"),
        )
        for c in inputs.CORPORA
    ]
    return spark.read.text(path).select(F.inline(F.array(*parts))).filter("total IS NOT NULL")


AUGMENT = {"analogies": 40, "examples": 100000000, "step_by_step": 30, "back_translation": 25}
ALL = dict.fromkeys(AUGMENT, 100000000)


def _stub_translator():
    """Marks a text with the language it is translated to."""
    return lambda texts, source, target: [f"{target}({t})" for t in texts]


@query(
    "augment_corpora",
    with_inputs(
        "chat",
        """SELECT * FROM (
             SELECT 'original' AS kind, count(*) AS records FROM chat
             UNION ALL SELECT 'analogies', least(40, count(*)) FROM chat
             UNION ALL SELECT 'examples', count(*) FROM chat
             UNION ALL SELECT 'step_by_step', least(30, count(*)) FROM chat
             UNION ALL SELECT 'back_translated', least(25, count(*)) FROM chat
             UNION ALL SELECT 'combined_augmented', 2 * count(*) + least(40, count(*)) + least(30, count(*)) + least(25, count(*)) FROM chat)""",
    ),
    workers=True,
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    """A training file augmented into files; the counts of what was written."""
    out = fresh_path(spark, "augment")
    jsonl.write_chat_jsonl(inputs.chat(spark, folder), f"{out}/combined_train.jsonl")
    stats = plans.run_augment(
        spark, f"{out}/combined_train.jsonl", out, AUGMENT, _stub_translator
    )
    return stats.filter(F.col("kind") != "combined_augmented").unionByName(
        jsonl.read_chat_jsonl(spark, f"{out}/combined_augmented.jsonl").records.agg(
            F.lit("combined_augmented").alias("kind"), F.count("*").alias("records")
        )
    )


_KINDS = {"original": "", "analogies": fixed.ANALOGY_REQUEST, "examples": fixed.EXAMPLES_REQUEST, "step_by_step": fixed.STEPS_REQUEST}
_APPENDED = " UNION ALL ".join(
    f"""SELECT '{kind}' AS kind, {"id" if kind == "original" else "NULL"} AS id, array_to_string(list_transform(messages, lambda m: m.role || '=' || m.content
        || CASE WHEN m.role = 'user' THEN {quoted(request)} ELSE '' END), '|') AS messages FROM numbered"""
    for kind, request in _KINDS.items()
)
_TRANSLATED = """SELECT 'back_translated', NULL, array_to_string(list_transform(messages, lambda m, i: m.role || '=' ||
        CASE WHEN i = list_position(list_transform(messages, lambda x: x.role), 'assistant')
             THEN 'en(de(' || CASE WHEN len(messages) >= 3 THEN messages[3].content ELSE '' END || '))' ELSE m.content END), '|') FROM numbered"""


@query(
    "augmented_contents",
    with_inputs(
        "chat",
        f"""SELECT kind, id, messages FROM (WITH numbered AS (SELECT conv_id AS id, messages FROM chat)
            {_APPENDED} UNION ALL {_TRANSLATED})""",
    ),
    workers=True,
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    """Every record in every kind, as written; a record that isn't changed keeps its other fields."""
    out = fresh_path(spark, "augment")
    chats = inputs.chat(spark, folder)
    record = F.to_json(F.struct(F.col("conv_id").alias("id"), "messages"), {"ignoreNullFields": "false"})
    jsonl.write_chat_jsonl(chats.withColumn("record", record), f"{out}/combined_train.jsonl")
    plans.run_augment(spark, f"{out}/combined_train.jsonl", out, ALL, _stub_translator)
    files = {**plans.FILES, "original": "combined_augmented.jsonl"}
    kinds = [
        jsonl.read_chat_jsonl(spark, f"{out}/{file}").records.select(
            F.lit(kind).alias("kind"),
            F.get_json_object("record", "$.id").cast("long").alias("id"),
            flat_messages().alias("messages"),
        )
        for kind, file in files.items()
    ]
    # The combined file has all kinds; the originals are those with an id.
    return sampling.concat_sets(*kinds).filter("kind <> 'original' OR id IS NOT NULL")


# --- text functions ------------------------------------------------------------------


@query(
    "clean_text",
    f"""SELECT doc_id, {clean("CASE WHEN doc_id % 11 <> 0 THEN chr(160) || chr(9) || text || chr(12288) || chr(10) END")} AS text
        FROM documents""",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    padded = F.concat(F.lit("\xa0\t"), "text", F.lit("　\n"))
    docs = inputs.table(spark, folder, "documents")
    return docs.select(
        "doc_id", clean_text(F.when(F.col("doc_id") % 11 != 0, padded)).alias("text")
    )


@query(
    "require_non_empty",
    with_inputs(
        "exchanges",
        f"""SELECT * FROM (SELECT key, {clean('question')} AS question, {clean('answer')} AS answer FROM exchanges)
            WHERE question <> '' AND answer <> ''""",
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.exchanges(spark, folder).select(
        "key", clean_text("question").alias("question"), clean_text("answer").alias("answer")
    )
    return qa.require_non_empty(rows, "question", "answer")


@query("best_answer", with_inputs("best", "SELECT key, best FROM best"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.scored(spark, folder)
    return rows.select("key", best_answer("answers.text", "answers.score").alias("best"))


@query("lookup_choice", with_inputs("chosen", "SELECT key, choice FROM chosen"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = lookup_choice("choices.label", "choices.text", clean_text("answerKey"))
    return inputs.keyed(spark, folder).select("key", found.alias("choice"))


@query("prune_columns", "SELECT doc_id, lang FROM documents")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return qa.prune(inputs.table(spark, folder, "documents"), ["doc_id", "lang", "title"])


DECK_PATH = """'in/' || source || '/' || doc_id || (['.pptx', '.PPTX', '.ppt', '.pdf'])[doc_id % 4 + 1]"""


@query(
    "only_decks",
    f"SELECT path FROM (SELECT {DECK_PATH} AS path FROM documents) WHERE lower(path) LIKE '%.pptx'",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    suffix = inputs.pick(F.col("doc_id"), (".pptx", ".PPTX", ".ppt", ".pdf"))
    path = F.concat(F.lit("in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), suffix)
    return only_decks(inputs.table(spark, folder, "documents").select(path.alias("path")))


@query(
    "first_answered_questions",
    with_inputs(
        "qa", "SELECT conv_id, turn, question FROM exchanges WHERE answer IS NOT NULL ORDER BY conv_id, turn LIMIT 100"
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    """The first n rows in source order, after the filter."""
    rows = inputs.exchanges(spark, folder).filter(F.col("answer").isNotNull())
    placed = rows.withColumn("place", F.struct("conv_id", "turn"))
    return qa.head_n(placed, 100, "place").select("conv_id", "turn", "question")


@query("render_user_turn", with_inputs("qa", f"SELECT key, user_turn FROM ({PREPARED})"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.qa(spark, folder).withColumn("corpus", F.initcap("corpus"))
    return chat.render_user_turn(rows).select("key", "user_turn")


@query(
    "build_messages",
    with_inputs(
        "qa",
        f"""SELECT key, corpus, 'system=' || {quoted(fixed.SYSTEM_TEXT)} || '|user=' || user_turn
                   || '|assistant=' || reply AS messages FROM ({PREPARED})""",
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    records = chat.build_messages(inputs.qa(spark, folder))
    return records.select("key", "corpus", flat_messages().alias("messages"))


@query(
    "preview",
    f"""SELECT doc_id, CASE WHEN t = '' THEN '(no text)' WHEN length(t) > 500 THEN left(t, 500) || '...' ELSE t END AS long,
               CASE WHEN t = '' THEN '(no notes)' WHEN length(t) > 200 THEN left(t, 200) || '...' ELSE t END AS short
        FROM (SELECT doc_id, {clean("CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END")} AS t FROM documents)""",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("text"))
    return inputs.table(spark, folder, "documents").select(
        "doc_id",
        preview(text, 500, fixed.NO_TEXT).alias("long"),
        preview(text, 200, fixed.NO_NOTES).alias("short"),
    )


STOPS = ["zz", ". E", "\n", "on"]


@query(
    "truncate_at_stop",
    "SELECT doc_id, "
    + clean(
        "CASE "
        + " ".join(
            f"WHEN contains(text, {quoted(s)}) THEN left(text, strpos(text, {quoted(s)}) - 1)"
            for s in STOPS
        )
        + " ELSE text END"
    )
    + " AS text FROM documents",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.table(spark, folder, "documents")
    return docs.select("doc_id", truncate_at_stop("text", STOPS).alias("text"))


# --- sampling ------------------------------------------------------------------------


@query(
    "concat_sets",
    with_inputs(
        "chat",
        f"""SELECT key, {FLAT.format('messages')} AS messages FROM chat
            UNION ALL SELECT key, {FLAT.format('messages')} FROM chat""",
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    records = inputs.chat(spark, folder).select("key", flat_messages().alias("messages"))
    return sampling.concat_sets(records, records)


@query(
    "seeded_shuffle",
    with_inputs("chat", "SELECT key, md5('42:' || key) AS place FROM chat ORDER BY place, key"),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    shuffled = sampling.seeded_shuffle(inputs.chat(spark, folder))
    return shuffled.select("key", sampling.random_order("key").alias("place"))


SPLIT = """SELECT key, CASE WHEN row_number() OVER (ORDER BY md5('42:' || key))
                  <= (SELECT floor(count(*) * 0.95) FROM chat) THEN 'train' ELSE 'val' END AS split FROM chat"""


@query("exact_split", with_inputs("chat", SPLIT))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.exact_split(inputs.chat(spark, folder)).select("key", "split")


@query(
    "exact_split_documents",
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('7:' || doc_id))
              <= (SELECT floor(count(*) * 0.95) FROM documents) THEN 'train' ELSE 'val' END AS split FROM documents""",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.table(spark, folder, "documents")
    return sampling.exact_split(docs, "doc_id", seed=7).select("doc_id", "split")


@query(
    "sample_n",
    """SELECT doc_id, lang, text FROM documents
       ORDER BY md5('42:' || doc_id) LIMIT 150""",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.table(spark, folder, "documents")
    return sampling.sample_n(docs, 150, "doc_id").select("doc_id", "lang", "text")


# --- augmentation --------------------------------------------------------------------


def _appended(seed: str, n: int, suffix: str) -> str:
    return with_inputs(
        "chat",
        f"""SELECT key, array_to_string(list_transform(messages, lambda m: m.role || '=' || m.content
                   || CASE WHEN m.role = 'user' THEN {quoted(suffix)} ELSE '' END), '|') AS messages
            FROM (SELECT * FROM chat ORDER BY md5('{seed}:' || key) LIMIT {n})""",
    )


@query("append_to_user_turns", _appended("42", 60, " (briefly)"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    records = chat.append_to_user_turns(inputs.chat(spark, folder), " (briefly)", 60)
    return records.select("key", flat_messages().alias("messages"))


for _name, _augment, _request in (
    ("analogy", chat.augment_analogy, fixed.ANALOGY_REQUEST),
    ("examples", chat.augment_examples, fixed.EXAMPLES_REQUEST),
    ("steps", chat.augment_steps, fixed.STEPS_REQUEST),
):

    def _run(spark: SparkSession, folder: str, augment=_augment) -> DataFrame:
        records = augment(inputs.chat(spark, folder), 50)
        return records.select("key", flat_messages().alias("messages"))

    query(f"augment_{_name}", _appended(f"42-{_name}", 50, _request))(_run)


def _replaced(text: str, source: str = "chat") -> str:
    return f"""array_to_string(list_transform(messages, lambda m, i: m.role || '=' ||
        CASE WHEN i = list_position(list_transform(messages, lambda x: x.role), 'assistant')
             THEN {text} ELSE m.content END), '|') AS messages FROM {source}"""


@query(
    "replace_first_assistant",
    with_inputs("chat", f"SELECT key, {_replaced("'new text for ' || key")}"),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    new = F.concat(F.lit("new text for "), "key")
    records = chat.replace_first_assistant(inputs.chat(spark, folder), new)
    return records.select("key", flat_messages().alias("messages"))


@query(
    "back_translate",
    with_inputs(
        "chat",
        f"""SELECT key, coalesce(list_position(list_transform(messages, lambda x: x.role), 'assistant') <> 3, true) AS mismatch,
            {_replaced(
                "'en(de(' || CASE WHEN len(messages) >= 3 THEN messages[3].content ELSE '' END || '))'",
                "(SELECT * FROM chat ORDER BY md5('42-back:' || key) LIMIT 70)")}""",
    ),
    workers=True,
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    records = back_translate(inputs.chat(spark, folder), _stub_translator, 70)
    return records.select("key", "mismatch", flat_messages().alias("messages"))


# --- validation and statistics -------------------------------------------------------

CHECKS = {
    fixed.NO_MESSAGES: "messages IS NULL",
    fixed.BAD_ROLE: "len(list_filter(messages, lambda m: coalesce(m.role, '') NOT IN ('system', 'user', 'assistant'))) > 0",
    fixed.NO_CONTENT: "len(list_filter(messages, lambda m: coalesce(m.content, '') = '')) > 0",
    fixed.NO_USER: "len(list_filter(messages, lambda m: m.role = 'user')) = 0",
    fixed.NO_ASSISTANT: "len(list_filter(messages, lambda m: m.role = 'assistant')) = 0",
}
VIOLATIONS = " UNION ALL ".join(
    f"SELECT key, '{name}' AS violation FROM faulty WHERE {rule}" for name, rule in CHECKS.items()
)


@query("validate_chat", with_inputs("faulty", VIOLATIONS))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return chat.validate_chat(inputs.faulty_chat(spark, folder))


@query(
    "validity",
    with_inputs(
        "faulty",
        "SELECT count(*) = 0 AS valid, count(*) AS errors, "
        + ", ".join(
            f"count(*) FILTER (violation = '{name}') AS {name.replace(' ', '_')}" for name in CHECKS
        )
        + f" FROM ({VIOLATIONS})",
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return chat.validity(inputs.faulty_chat(spark, folder))


@query(
    "length_stats",
    with_inputs(
        "chat",
        f"SELECT corpus, {LENGTHS} FROM (SELECT {CORPUS.format('conv_id')} AS corpus, {SIZES} FROM chat) GROUP BY corpus",
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    records = inputs.chat(spark, folder).withColumn(
        "corpus", inputs.pick(F.col("conv_id"), inputs.CORPORA)
    )
    return _rounded(chat.length_stats(records, "corpus"))


def chat_health(spark: SparkSession, folder: str) -> DataFrame:
    """Records, violations and turn lengths, by whether a record has a system prompt."""
    records = inputs.faulty_chat(spark, folder)
    has_system = F.coalesce(chat.has_role("messages", "system"), F.lit(False))
    records = records.withColumn("has_system", has_system)
    bad = F.size(chat.violations_of())
    faults = records.groupBy("has_system").agg(F.sum(bad).alias("violations"))
    return _rounded(chat.length_stats(records, "has_system")).join(faults, "has_system")


query(
    "chat_health",
    with_inputs(
        "faulty",
        f"""SELECT has_system, {LENGTHS}, CAST(sum(bad) AS BIGINT) AS violations
            FROM (SELECT coalesce(len(list_filter(messages, lambda m: m.role = 'system')) > 0, false) AS has_system, {SIZES},
                         {' + '.join(f"CASE WHEN {rule} THEN 1 ELSE 0 END" for rule in CHECKS.values())} AS bad FROM faulty)
            GROUP BY has_system""",
    ),
)(chat_health)


@query("split_counts", with_inputs("chat", f"SELECT split, count(*) AS rows FROM ({SPLIT}) GROUP BY split"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.split_counts(sampling.exact_split(inputs.chat(spark, folder)))


@query(
    "augmentation_stats",
    with_inputs(
        "chat",
        """SELECT * FROM (SELECT 'original' AS kind, count(*) AS records FROM chat
           UNION ALL SELECT 'analogies', least(30, count(*)) FROM chat
           UNION ALL SELECT 'examples', least(20, count(*)) FROM chat
           UNION ALL SELECT 'step_by_step', least(10, count(*)) FROM chat
           UNION ALL SELECT 'combined_augmented', count(*) + least(30, count(*)) + least(20, count(*)) + least(10, count(*)) FROM chat)""",
    ),
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    sizes = {"analogies": 30, "examples": 20, "step_by_step": 10}
    return chat.augmentation_stats(plans.augment(inputs.chat(spark, folder), sizes))
