"""Text cleaning over whole documents."""

from pyspark.sql import functions as F

from qaforge.functions import text as T

from qaforge.plans.site_corpus import conversation_pairs
from qaforge.queries.base import (
    DOC_QA_CTE, PAIRS_CTE, WS, clean_sql, distinct_sql, doc_qa, lit, query, sentences_sql, strip_sql, table,
)
from qaforge.rules import lexicons as R


@query("clean_text", f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


_numbered = f"regexp_replace(regexp_replace(doc_id || '. ' || text || ' ' || doc_id || '.', '[¶Â]|<\\[\\d+\\]', '', 'g'), '{WS}+', ' ', 'g')"
_numbered = f"regexp_replace({_numbered}, '(?i)^q(?:[ .:;\\-)]+\\d*|\\d+)\\.? *', '')"
_numbered = f"regexp_replace(regexp_replace({_numbered}, '^\\d+\\. *', ''), ' +\\d+\\. *$', '')"
_numbered = f"regexp_replace({strip_sql(_numbered)}, '\\[[^\\]\\n]*\\]', ' ', 'g')"


@query(
    "clean_text_numbered",
    f"WITH c AS (SELECT doc_id, {sentences_sql(_numbered)} AS s FROM documents) "
    f"SELECT doc_id, {strip_sql(f'''array_to_string({distinct_sql('s')}, ' ')''')} AS cleaned FROM c",
)
def clean_text_numbered(spark, d):
    text = F.concat_ws("", "doc_id", F.lit(". "), "text", F.lit(" "), "doc_id", F.lit("."))
    return table(spark, d, "documents").select("doc_id", T.clean_text_numbered(text).alias("cleaned"))


@query(
    "dedupe_sentences",
    f"WITH c AS (SELECT doc_id, {sentences_sql('text')} AS s FROM documents) "
    f"SELECT doc_id, array_to_string({distinct_sql('s')}, ' ') AS deduped FROM c",
)
def dedupe_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", T.dedupe_sentences(F.col("text")).alias("deduped"))


@query("ascii_fold", "SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]+', '', 'g') AS folded FROM documents")
def ascii_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", T.ascii_fold(F.col("text")).alias("folded"))


# Every second comma turns into an apostrophe form, so that expansions have something to do.
_contracted = "replace(replace(text, ', ', ' it''s '), ' the ', ' don''t ')"
_expanded = _contracted
for _f, _t in R.CONTRACTIONS:
    _expanded = f"replace({_expanded}, {lit(_f)}, {lit(_t)})"


@query("expand_contractions", f"SELECT doc_id, {_expanded} AS expanded FROM documents")
def expand_contractions(spark, d):
    text = F.replace(F.replace(F.col("text"), F.lit(", "), F.lit(" it's ")), F.lit(" the "), F.lit(" don't "))
    return table(spark, d, "documents").select("doc_id", T.expand_contractions(text).alias("expanded"))


_QUESTION = (
    "(?i)(?:^|[^\\p{L}\\p{N}_])(?:" + "|".join(R.QUESTION_WORDS) + ")(?:[^\\p{L}\\p{N}_\\n][^\\n]*)?\\?"
)
# Pairs whose answers repeat the first sentence of the question and ask in between.
_CUT_INPUT = f"""{PAIRS_CTE}, cut AS (
  SELECT conv_id, turn, {sentences_sql('question')}[1] AS q,
         replace(answer, ', ', '? ') || ' ' || question || ' ' || answer AS a FROM pairs)"""


def _cut_pairs(spark, d):
    pairs = conversation_pairs(table(spark, d, "conversations"))
    return pairs.select(
        "conv_id", "turn", T.sentences(F.col("question"))[0].alias("q"),
        F.concat_ws(" ", F.replace(F.col("answer"), F.lit(", "), F.lit("? ")), "question", "answer").alias("a"),
    )


@query(
    "cut_answer",
    f"""WITH {_CUT_INPUT}, s AS (SELECT conv_id, turn, lower(q) AS q, {sentences_sql('a')} AS s FROM cut),
    p AS (SELECT *, list_position(list_transform(s, lambda x: regexp_matches(x, {lit(_QUESTION)}) OR contains(lower(x), q)), true) AS stop FROM s)
    SELECT conv_id, turn, {strip_sql("array_to_string(CASE WHEN stop > 0 THEN s[1:stop - 1] ELSE s END, ' ')")} AS cut FROM p""",
)
def cut_answer(spark, d):
    return _cut_pairs(spark, d).select("conv_id", "turn", T.cut_answer(F.col("a"), F.col("q")).alias("cut"))


@query(
    "cut_answer_v2",
    f"""WITH {_CUT_INPUT}, s AS (SELECT conv_id, turn, lower(q) AS q, {sentences_sql("regexp_replace('A: ' || a, '(?i)^' || '" + WS + "' || '*(?:A:|Answer:)' || '" + WS + "' || '*', '')")} AS s FROM cut),
    p AS (SELECT *, list_position(list_transform(s, lambda x: regexp_matches(x, {lit(_QUESTION)})), true) AS stop FROM s),
    j AS (SELECT conv_id, turn, q, {strip_sql("array_to_string(list_filter(CASE WHEN stop > 0 THEN s[1:stop - 1] ELSE s END, lambda x: NOT contains(lower(x), q)), ' ')")} AS t FROM p)
    SELECT conv_id, turn, CASE WHEN length(t) < 10 OR lower(t) = q THEN '' ELSE t END AS cut FROM j""",
)
def cut_answer_v2(spark, d):
    answer = F.concat(F.lit("A: "), F.col("a"))
    return _cut_pairs(spark, d).select("conv_id", "turn", T.cut_answer_v2(answer, F.col("q")).alias("cut"))


_starts = "|".join(s.replace(r"\s", WS) for s in R.QUESTION_STARTS)


@query(
    "looks_like_question",
    f"""WITH t AS (SELECT doc_id, i, {strip_sql('line')} AS line FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))
    SELECT doc_id, i, line <> '' AND (ends_with(line, '?') OR regexp_matches(line, '(?i)^(?:q[.\\-:)]*{WS}*\\d*{WS}*|{_starts})(?:$|[^\\p{{L}}\\p{{N}}_])')) AS asks FROM t""",
)
def looks_like_question(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", "i", T.looks_like_question(F.col("line")).alias("asks"))


@query(
    "strip_qa_prefix",
    f"SELECT doc_id, {strip_sql('''replace('Q: ' || text, 'Q:', '')''')} AS q, {strip_sql('''replace(replace(text, '. ', '. A: '), 'A:', '')''')} AS a FROM documents",
)
def strip_qa_prefix(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        T.strip_qa_prefix(F.concat(F.lit("Q: "), "text")).alias("q"),
        T.strip_qa_prefix(F.replace(F.col("text"), F.lit(". "), F.lit(". A: ")), "A:").alias("a"),
    )


@query("min_length", f"WITH {DOC_QA_CTE} SELECT pos, question, answer FROM qa WHERE length(question) >= 5 AND length(answer) >= 20")
def min_length(spark, d):
    return T.min_length(doc_qa(spark, d), q_min=5, a_min=20).select("pos", "question", "answer")


@query("collapse_redundant")
def collapse_redundant(spark, d):
    # Lines of a document under one shared opening, as an answer that repeats itself has them.
    opened = F.array_join(F.transform(F.split("text", "\n"), lambda s: F.concat(F.lit("You can also see "), s)), "\n")
    return table(spark, d, "documents").select("doc_id", T.collapse_redundant(opened).alias("collapsed"))


_leak = R.LEAKED_PHRASES[2]


@query(
    "strip_echo",
    f"""WITH {PAIRS_CTE}, t AS (
      SELECT conv_id, turn, {strip_sql("question || chr(10) || '- ' || answer || chr(10) || " + lit(_leak + " now") + " || chr(10) || answer")} AS t, {strip_sql('question')} AS q FROM pairs),
    u AS (SELECT conv_id, turn, CASE WHEN q <> '' AND starts_with(t, q) THEN regexp_replace(substr(t, length(q) + 1), '^[\\n: \\-]+', '') ELSE t END AS u FROM t),
    k AS (SELECT conv_id, turn, u, {strip_sql("array_to_string(list_filter(string_split_regex(u, '\\r\\n|[\\x{0a}-\\x{0d}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]'), lambda l: NOT (" + " OR ".join(f"contains(l, {lit(p)})" for p in R.LEAKED_PHRASES) + ")), chr(10))")} AS k FROM u)
    SELECT conv_id, turn, CASE WHEN k = '' THEN u ELSE k END AS response FROM k""",
)
def strip_echo(spark, d):
    pairs = conversation_pairs(table(spark, d, "conversations"))
    raw = F.concat("question", F.lit("\n- "), "answer", F.lit(f"\n{_leak} now\n"), "answer")
    return pairs.select("conv_id", "turn", T.strip_echo(raw, F.col("question")).alias("response"))


@query(
    "text_lengths",
    "SELECT doc_id, len(string_split(text, ' ')) AS n_words, length(text) AS n_characters FROM documents",
)
def text_lengths(spark, d):
    return T.text_lengths(table(spark, d, "documents").select("doc_id", "text")).drop("text")


# Without look-ahead: commas after the last opening parenthesis of each closed pair.
@query(
    "csv_safe_parens",
    """WITH s AS (SELECT p_partkey, 'decimal(' || p_size || ',2), ' || p_name || ', (' || p_brand || ', ' || p_type || ',x)' AS t FROM part)
    SELECT p_partkey, 'decimal(' || p_size || ';2), ' || p_name || ', (' || p_brand || '; ' || p_type || ';x)' AS safe FROM s JOIN part USING (p_partkey)""",
)
def csv_safe_parens(spark, d):
    text = F.concat_ws(
        "", F.lit("decimal("), "p_size", F.lit(",2), "), "p_name", F.lit(", ("), "p_brand", F.lit(", "), "p_type", F.lit(",x)")
    )
    return table(spark, d, "part").select("p_partkey", T.csv_safe_parens(text).alias("safe"))


