"""Labels over whole documents and events."""

from pyspark.sql import functions as F

from qaforge.functions import labels as L
from qaforge.functions.common import WS, strip
from qaforge.queries.base import (
    any_sql, arr, best_sql, cue, cue_sql, first_sql, hits_sql, keywords_sql, lit, lookup_sql, prompts,
    prompts_cte, query, strip_sql, table, words_sql,
)
from qaforge.rules import lexicons as R


def _flat(rules):
    return [w for cues in rules.values() for w in cues]


INTENT_CUES = _flat(R.INTENT6)
INDUSTRY_CUES = _flat(R.INDUSTRY8)
TOPIC_CUES = [*R.TOPIC_TONES, *R.GENERIC_WORDS]
PERSONA_CUES = [w for _, cues in R.PERSONA_RULES.values() for w in cues] + R.GENERIC_WORDS
GUESS_CUES = _flat(R.PLATFORM_GUESS) + _flat(R.TOUCHPOINT_GUESS)
ENERGY_CUES = R.ENERGY_WORDS + R.ENERGY_MARKS
STYLE_CUES = R.STYLE_TUTORIAL + R.STYLE_CURIOUS + R.STYLE_FRIENDLY + R.STYLE_PROFESSIONAL + R.STYLE_NOT_CONCISE
AGE_CUES = _flat(R.AGE_SLANG)
CONTEXT_NAMES = ["support", "technical", "sales", "booking", "travel", "legal", "education"]


def scored_cte(rules, cues, default: str) -> str:
    """Prompts with one score column per label and the winning label."""
    scores = {k: f"s{i}" for i, k in enumerate(rules)}
    cols = ", ".join(f"{hits_sql('t', v)} AS s{i}" for i, v in enumerate(rules.values()))
    return (
        f"{prompts_cte(cues)}, low AS (SELECT id, n, lower(text) AS t FROM prompts), "
        f"sc AS (SELECT id, n, {cols} FROM low), lab AS (SELECT id, n, {best_sql(scores, lit(default))} AS label FROM sc)"
    )


@query(
    "keywords",
    f"""WITH {prompts_cte(TOPIC_CUES)}
    SELECT id, array_to_string({keywords_sql('text')}, ' ') AS by_word,
      array_to_string({words_sql('lower(text)')}, ' ') AS by_space,
      array_to_string(regexp_extract_all(lower(text), '[a-z]{{4,}}'), ' ') AS by_letters FROM prompts""",
)
def keywords(spark, d):
    t = F.col("text")
    return prompts(spark, d, TOPIC_CUES).select(
        "id", F.array_join(L.keywords(t), " ").alias("by_word"),
        F.array_join(L.keywords(t, "space"), " ").alias("by_space"),
        F.array_join(L.keywords(t, "regex4"), " ").alias("by_letters"),
    )


_bare = "regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')"


@query(
    "sentiment",
    f"""WITH lex AS (SELECT DISTINCT token, CAST(length(token) % 5 - 2 AS DOUBLE) AS valence FROM (
        SELECT unnest({words_sql('lower(text)')}) AS token FROM benchmark)),
    tok AS (SELECT doc_id, {_bare} AS token FROM (SELECT doc_id, unnest({words_sql('lower(text)')}) AS w FROM documents)),
    v AS (SELECT doc_id, tok.token, coalesce(valence, 0) AS v FROM tok LEFT JOIN lex ON tok.token = lex.token),
    s AS (SELECT doc_id, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS p,
      sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS n, sum(CASE WHEN v = 0 AND token <> '' THEN 1.0::DOUBLE ELSE 0 END) AS u FROM v GROUP BY doc_id)
    SELECT doc_id, CASE WHEN p + n + u > 0 THEN round(n / (p + n + u), 3) ELSE 0 END AS neg,
      CASE WHEN p + n + u > 0 THEN round(u / (p + n + u), 3) ELSE 1 END AS neu,
      CASE WHEN p + n + u > 0 THEN round(p / (p + n + u), 3) ELSE 0 END AS pos,
      round(s / sqrt(s * s + 15), 4) AS compound FROM s""",
)
def sentiment(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), f"{WS}+")).alias("token"))
    lexicon = (
        words.filter("token <> ''").distinct().withColumn("valence", (F.length("token") % 5 - 2).cast("double"))
    )
    return L.sentiment(table(spark, d, "documents"), "text", lexicon, "doc_id")


_C1, _C2 = "(value % 20) / 10 - 1", "(user_id % 21) / 10.0 - 1"


def _compounds(spark, d):
    return table(spark, d, "events").select(
        "event_id", (F.col("value") % 20 / 10 - 1).alias("c1"),
        (F.col("user_id") % 21 / F.lit(10.0) - 1).alias("c2"),
    )


def _tone_sql(c):
    return (
        f"CASE WHEN {c} > 0.5 THEN 'enthusiastic' WHEN {c} > 0.2 THEN 'positive' WHEN {c} < -0.5 THEN 'urgent' "
        f"WHEN {c} < -0.2 THEN 'negative' ELSE 'neutral' END"
    )


@query(
    "tone",
    f"""WITH c AS (SELECT event_id, {_C1} AS c1, CAST(user_id % 21 AS DOUBLE) / CAST(10 AS DOUBLE) - 1 AS c2 FROM events)
    SELECT event_id, {_tone_sql('c1')} AS tone_one, {_tone_sql('((c1 + c2) / 2)')} AS tone_two,
      CASE WHEN (c1 + c2) / 2 > CAST(0.3 AS DOUBLE) THEN 'positive' WHEN (c1 + c2) / 2 < CAST(-0.3 AS DOUBLE) THEN 'negative' ELSE 'neutral' END AS tone_three FROM c""",
)
def tone(spark, d):
    c1, c2 = F.col("c1"), F.col("c2")
    return _compounds(spark, d).select(
        "event_id", L.tone(c1).alias("tone_one"), L.tone(c1, c2).alias("tone_two"), L.tone3(c1, c2).alias("tone_three")
    )


_topics_found = f"list_filter({arr(list(R.TOPIC_TONES))}, lambda t: list_contains(kw, t))"
_generic = f"len(list_filter({arr(R.GENERIC_WORDS)}, lambda g: list_contains(kw, g))) > 0"
KW_CTE = """kw AS (SELECT id, n, {kw} AS kw, {ctx} AS ctx FROM prompts)"""


def _ctx_sql():
    return cue_sql("n", ["", *CONTEXT_NAMES])


def _ctx():
    return cue(F.col("n"), ["", *CONTEXT_NAMES])


TOPICS_CTE = f"""{prompts_cte(TOPIC_CUES)}, {KW_CTE.format(kw=keywords_sql('text'), ctx=_ctx_sql())},
    f AS (SELECT id, n, ctx, kw, {_topics_found} AS found, {_generic} AS generic FROM kw),
    g AS (SELECT id, n, ctx, kw, CASE WHEN generic THEN list_concat(found, list_filter({arr(R.GENERIC_TOPICS)}, lambda x: NOT list_contains(found, x))) ELSE found END AS found FROM f),
    topics AS (SELECT id, n, ctx, kw, CASE WHEN len(found) > 0 THEN found WHEN ctx <> '' THEN [ctx] ELSE ['general'] END AS topics FROM g)"""


@query("topics", f"WITH {TOPICS_CTE} SELECT id, array_to_string(topics, '|') AS topics FROM topics")
def topics(spark, d):
    p = prompts(spark, d, TOPIC_CUES)
    return p.select("id", F.array_join(L.topics(L.keywords(F.col("text")), _ctx()), "|").alias("topics"))


def _persona_when(p):
    contexts, cues = R.PERSONA_RULES[p]
    parts = [f"list_contains(kw, {lit(c)})" for c in cues] + [f"ctx = {lit(c)}" for c in contexts]
    return "(" + " OR ".join(parts) + ")"


PERSONAS_CTE = f"""f AS (SELECT id, n, ctx, kw, list_filter([{', '.join(f"CASE WHEN {_persona_when(p)} THEN {lit(p)} END" for p in R.PERSONA_RULES)}], lambda x: x IS NOT NULL) AS found, {_generic} AS generic FROM kw),
    g AS (SELECT id, n, ctx, kw, CASE WHEN generic THEN list_concat(found, list_filter({arr(R.GENERIC_PERSONAS)}, lambda x: NOT list_contains(found, x))) ELSE found END AS found FROM f),
    personas AS (SELECT id, n, ctx, kw, CASE WHEN len(found) > 0 THEN found ELSE ['helpful assistant'] END AS personas FROM g)"""


@query(
    "personas",
    f"WITH {prompts_cte(PERSONA_CUES)}, {KW_CTE.format(kw=keywords_sql('text'), ctx=_ctx_sql())}, {PERSONAS_CTE} "
    "SELECT id, array_to_string(personas, '|') AS personas FROM personas",
)
def personas(spark, d):
    p = prompts(spark, d, PERSONA_CUES)
    return p.select("id", F.array_join(L.personas(L.keywords(F.col("text")), _ctx()), "|").alias("personas"))


_single = "CASE " + " ".join(f"WHEN {_persona_when(p)} THEN {lit(p)}" for p in R.SINGLE_PERSONAS) + " ELSE 'helpful assistant' END"
_single_topic = f"coalesce({_topics_found}[1], nullif(ctx, ''), 'general')"


@query(
    "single_persona_topic",
    f"WITH {prompts_cte(PERSONA_CUES + list(R.TOPIC_TONES))}, {KW_CTE.format(kw=keywords_sql('text'), ctx=_ctx_sql())} "
    f"SELECT id, {_single} AS persona, {_single_topic} AS topic FROM kw",
)
def single_persona_topic(spark, d):
    p = prompts(spark, d, PERSONA_CUES + list(R.TOPIC_TONES)).withColumn("kw", L.keywords(F.col("text")))
    return p.select(
        "id", L.persona_single(F.col("kw"), _ctx()).alias("persona"), L.topic_single(F.col("kw"), _ctx()).alias("topic")
    )


def _points(who, rules):
    parts = []
    for targets, when, cues, points in rules:
        test = any_sql("lc", cues) + (f" OR ctx = {lit(when)}" if when else "")
        parts.append(f"CASE WHEN {who} IN ({', '.join(lit(t) for t in targets)}) AND ({test}) THEN {points} ELSE 0 END")
    return " + ".join(parts)


_order_p = "CASE who " + " ".join(f"WHEN {lit(v)} THEN {i}" for i, v in enumerate(R.PERSONA_ORDER)) + " ELSE 999 END"
_order_t = "CASE who " + " ".join(f"WHEN {lit(v)} THEN {i}" for i, v in enumerate(R.TOPIC_ORDER)) + " ELSE 999 END"
RANK_CUES = PERSONA_CUES + [w for _, _, cues, _ in R.PERSONA_SCORES + R.TOPIC_SCORES for w in cues]


def rank_cte(with_context_words: bool = False) -> str:
    """Best persona and topic per prompt; optionally the words of the context count as keywords."""
    kw = keywords_sql("text")
    if with_context_words:
        own = f"CASE {_ctx_sql()} " + " ".join(f"WHEN {lit(k)} THEN {arr(v)}" for k, v in R.CONTEXTS.items()) + " ELSE CAST([] AS VARCHAR[]) END"
        kw = f"list_distinct(list_concat({kw}, {own}))"
    return f"""{prompts_cte(RANK_CUES)}, {KW_CTE.format(kw=kw, ctx=_ctx_sql())}, {PERSONAS_CTE},
    tf AS (SELECT id, {_topics_found} AS found, {_generic} AS generic, ctx FROM kw),
    tg AS (SELECT id, ctx, CASE WHEN generic THEN list_concat(found, list_filter({arr(R.GENERIC_TOPICS)}, lambda x: NOT list_contains(found, x))) ELSE found END AS found FROM tf),
    tt AS (SELECT id, CASE WHEN len(found) > 0 THEN found WHEN ctx <> '' THEN [ctx] ELSE ['general'] END AS topics FROM tg),
    lc AS (SELECT id, n, ctx, personas, array_to_string(list_sort(list_distinct(kw)), ' ') AS lc FROM personas),
    pe AS (SELECT id, ctx, lc, unnest(personas[1:3]) AS who, unnest(range(len(personas[1:3]))) AS i FROM lc),
    pr AS (SELECT id, arg_min(who, ROW(-({_points('who', R.PERSONA_SCORES)} + CASE WHEN ctx <> '' AND contains(replace(ctx, ' ', ''), replace(who, ' ', '')) THEN 1 ELSE 0 END), {_order_p}, i)) AS persona FROM pe GROUP BY id),
    te AS (SELECT lc.id, lc.ctx, lc.lc, unnest(tt.topics[1:2]) AS who, unnest(range(len(tt.topics[1:2]))) AS i FROM lc JOIN tt ON lc.id = tt.id),
    tr AS (SELECT id, arg_min(who, ROW(-({_points('who', R.TOPIC_SCORES)}), {_order_t}, i)) AS topic FROM te GROUP BY id),
    ranked AS (SELECT pr.id, persona, topic FROM pr JOIN tr ON pr.id = tr.id)"""


@query("rank_persona_topic", f"WITH {rank_cte()} SELECT id, persona, topic FROM ranked")
def rank_persona_topic(spark, d):
    p = prompts(spark, d, RANK_CUES).withColumn("kw", L.keywords(F.col("text"))).withColumn("ctx", _ctx())
    kw, ctx = F.col("kw"), F.col("ctx")
    p = p.withColumns({"p": L.personas(kw, ctx), "t": L.topics(kw, ctx)})
    return p.select("id", L.rank_persona_topic(F.col("p"), F.col("t"), kw, ctx).alias("r")).select("id", "r.*")


for _name, _rules, _cues, _default, _fn in (
    ("intent6", R.INTENT6, INTENT_CUES, "information", L.intent6),
    ("intent4", R.INTENT4, INTENT_CUES, "information", L.intent4),
    ("domain5", R.DOMAIN5, _flat(R.DOMAIN5), "product", L.domain5),
):

    @query(_name, f"WITH {scored_cte(_rules, _cues, _default)} SELECT id, label FROM lab")
    def _scored(spark, d, cues=_cues, fn=_fn):
        return prompts(spark, d, cues).select("id", fn(F.col("text")).alias("label"))


_i_tone = lookup_sql("label", {k: v[0] for k, v in R.INDUSTRY_INFO.items()}, "'neutral'")
_i_desc = lookup_sql("label", {k: v[1] for k, v in R.INDUSTRY_INFO.items()}, "'General'")


@query(
    "industry8",
    f"WITH {scored_cte(R.INDUSTRY8, INDUSTRY_CUES, 'general')} SELECT id, label, {_i_tone} AS tone, {_i_desc} AS description FROM lab",
)
def industry8(spark, d):
    return prompts(spark, d, INDUSTRY_CUES).select("id", L.industry8(F.col("text")).alias("i")).select("id", "i.*")


@query(
    "industry_first",
    f"""WITH {prompts_cte(INDUSTRY_CUES)}, f AS (SELECT id, {first_sql('lower(text)', R.INDUSTRY8, "'general'")} AS label FROM prompts)
    SELECT id, label AS domain, {_i_tone} AS tone, 'information' AS intent, CASE WHEN label = 'general' THEN 'helpful assistant' ELSE label || ' expert' END AS persona FROM f""",
)
def industry_first(spark, d):
    return prompts(spark, d, INDUSTRY_CUES).select("id", L.industry_first(F.col("text")).alias("i")).select("id", "i.*")


CONTEXT_CUES = _flat(R.CONTEXTS)
_url = f"url || '/' || {cue_sql('page_id', ['a', 'b', 'c', *CONTEXT_CUES])}"
_pages_cte = f"p AS (SELECT page_id, lower({_url}) AS u, lower(html || {cue_sql('page_id', CONTEXT_CUES, 5)} || ' ' || {cue_sql('page_id', CONTEXT_CUES, 7)}) AS h FROM pages)"


def _context_pages(spark, d):
    i = F.col("page_id")
    return table(spark, d, "pages").select(
        "page_id", F.concat_ws("/", "url", cue(i, ["a", "b", "c", *CONTEXT_CUES])).alias("url"),
        F.concat("html", cue(i, CONTEXT_CUES, 5), F.lit(" "), cue(i, CONTEXT_CUES, 7)).alias("html"),
    )


@query(
    "page_context_first",
    f"WITH {_pages_cte} SELECT page_id, CASE "
    + " ".join(f"WHEN {any_sql('u', v)} OR {any_sql('h', v)} THEN {lit(k)}" for k, v in R.CONTEXTS.items())
    + " ELSE 'support' END AS context FROM p",
)
def page_context_first(spark, d):
    return _context_pages(spark, d).select("page_id", L.page_context_first(F.col("url"), F.col("html")).alias("context"))


_count = {
    k: " + ".join(f"(length(h) - length(replace(h, {lit(w)}, ''))) // {len(w)}" for w in v) for k, v in R.CONTEXTS.items()
}


@query(
    "page_context_counted",
    f"WITH {_pages_cte}, s AS (SELECT page_id, u, {', '.join(f'{v} AS s_{k}' for k, v in _count.items())} FROM p) "
    f"SELECT page_id, {first_sql('u', R.CONTEXTS, best_sql({k: f's_{k}' for k in R.CONTEXTS}, lit('general')))} AS context FROM s",
)
def page_context_counted(spark, d):
    return _context_pages(spark, d).select("page_id", L.page_context_counted(F.col("url"), F.col("html")).alias("context"))


PLATFORM_NAMES = [*R.PLATFORMS, "My Instagram Feed", "kiosk", "Support_Chat v2"]
TOUCHPOINT_NAMES = [*R.TOUCHPOINTS, "the Checkout lane", "lobby"]
_name = f"c_name || ' ' || {cue_sql('c_custkey', PLATFORM_NAMES)}"
_pkey = first_sql("lower(t)", {k: [k] for k in R.PLATFORMS}, "''")


@query(
    "platform_info",
    f"""WITH n AS (SELECT c_custkey, {_name} AS t FROM customer), k AS (SELECT c_custkey, {_pkey} AS k FROM n)
    SELECT c_custkey, {lookup_sql('k', {k: v[0] for k, v in R.PLATFORMS.items()}, lit(R.PLATFORM_DEFAULT[0]))} AS tone,
      {lookup_sql('k', {k: v[2] for k, v in R.PLATFORMS.items()}, lit(R.PLATFORM_DEFAULT[2]))} AS style,
      {lookup_sql('k', {k: v[1] for k, v in R.PLATFORMS.items()}, lit(R.PLATFORM_DEFAULT[1]))} AS description FROM k""",
)
def platform_info(spark, d):
    name = F.concat_ws(" ", "c_name", cue(F.col("c_custkey"), PLATFORM_NAMES))
    return table(spark, d, "customer").select("c_custkey", L.platform_info(name).alias("i")).select("c_custkey", "i.*")


_tname = f"c_name || ' ' || {cue_sql('c_custkey', TOUCHPOINT_NAMES)}"
_tkey = first_sql("lower(t)", {k: [k] for k in R.TOUCHPOINTS}, "''")


@query(
    "touchpoint_info",
    f"""WITH n AS (SELECT c_custkey, {_tname} AS t FROM customer), k AS (SELECT c_custkey, {_tkey} AS k FROM n)
    SELECT c_custkey, {lookup_sql('k', {k: v[0] for k, v in R.TOUCHPOINTS.items()}, lit(R.TOUCHPOINT_DEFAULT[0]))} AS intent,
      {lookup_sql('k', {k: v[1] for k, v in R.TOUCHPOINTS.items()}, lit(R.TOUCHPOINT_DEFAULT[1]))} AS description FROM k""",
)
def touchpoint_info(spark, d):
    name = F.concat_ws(" ", "c_name", cue(F.col("c_custkey"), TOUCHPOINT_NAMES))
    return table(spark, d, "customer").select("c_custkey", L.touchpoint_info(name).alias("i")).select("c_custkey", "i.*")


@query(
    "guess_controls",
    f"WITH {prompts_cte(GUESS_CUES)} SELECT id, {first_sql('lower(text)', R.PLATFORM_GUESS, lit('corporate_website'))} AS platform, "
    f"{first_sql('lower(text)', R.TOUCHPOINT_GUESS, lit('support_page'))} AS touchpoint FROM prompts",
)
def guess_controls(spark, d):
    t = F.col("text")
    return prompts(spark, d, GUESS_CUES).select(
        "id", L.guess_platform(t).alias("platform"), L.guess_touchpoint(t).alias("touchpoint")
    )


def _energy_sql(words):
    return f"(length(text) - length(replace(text, '!', '')) + {hits_sql('lower(text)', words)})"


def _level_sql(s):
    return f"CASE WHEN text = '' THEN 'medium' WHEN {s} >= 2 THEN 'high' WHEN {s} = 1 THEN 'medium' ELSE 'low' END"


_levels = {"full": R.ENERGY_WORDS, "short": R.ENERGY_WORDS_SHORT, "shortest": R.ENERGY_WORDS_SHORTEST}


@query(
    "energy",
    f"WITH {prompts_cte(ENERGY_CUES)}, s AS (SELECT id, text, {', '.join(f'{_energy_sql(v)} AS s_{k}' for k, v in _levels.items())} FROM prompts) "
    f"SELECT id, {', '.join(f'{_level_sql(f's_{k}')} AS level_{k}, s_{k} AS score_{k}' for k in _levels)} FROM s",
)
def energy(spark, d):
    p = prompts(spark, d, ENERGY_CUES)
    for k, words in _levels.items():
        p = p.withColumn(f"_{k}", L.energy(F.col("text"), words))
    return p.select(
        "id", *[F.col(f"_{k}.level").alias(f"level_{k}") for k in _levels],
        *[F.col(f"_{k}.score").alias(f"score_{k}") for k in _levels],
    )


@query(
    "energy_binary",
    f"""WITH {prompts_cte(ENERGY_CUES)}, m AS (SELECT id, CASE WHEN n % 2 = 0 THEN upper(text) ELSE text END AS t FROM prompts),
    e AS (SELECT id, CASE WHEN {any_sql('t', R.ENERGY_MARKS)} OR (upper(t) = t AND lower(t) <> t) THEN 'high' ELSE 'normal' END AS energy FROM m)
    SELECT id, energy, CASE WHEN energy = 'high' THEN 'formal, enthusiastic' ELSE 'formal' END AS tone FROM e""",
)
def energy_binary(spark, d):
    p = prompts(spark, d, ENERGY_CUES).withColumn("t", F.when(F.col("n") % 2 == 0, F.upper("text")).otherwise(F.col("text")))
    p = p.select("id", L.energy_binary(F.col("t")).alias("energy"))
    return p.withColumn("tone", L.energetic_tone(F.lit("formal"), F.col("energy")))


def _style_sql(t, n):
    return (
        f"CASE WHEN {any_sql(t, R.STYLE_TUTORIAL)} THEN 'educational_tutorial' "
        f"WHEN {n} > 0 AND {n} <= 10 AND NOT {any_sql(t, R.STYLE_NOT_CONCISE)} THEN 'direct_concise' "
        f"WHEN {any_sql(t, R.STYLE_CURIOUS)} THEN 'curious_engaged' WHEN {any_sql(t, R.STYLE_FRIENDLY)} THEN 'friendly_conversational' "
        f"WHEN {any_sql(t, R.STYLE_PROFESSIONAL)} THEN 'professional_clear' ELSE 'neutral' END"
    )


@query(
    "prompt_style",
    f"WITH {prompts_cte(STYLE_CUES)}, w AS (SELECT id, lower(text) AS t, len({words_sql('text')}) AS k FROM prompts) SELECT id, {_style_sql('t', 'k')} AS style FROM w",
)
def prompt_style(spark, d):
    return prompts(spark, d, STYLE_CUES).select("id", L.prompt_style(F.col("text")).alias("style"))


_tech = f"len(list_filter(regexp_extract_all(t, '[a-zA-Z]{{4,}}'), lambda x: list_contains({arr(R.TECHNICAL_WORDS)}, lower(x))))"
_logic = any_sql("lower(t)", R.LOGIC_WORDS)
_cx = f"""{prompts_cte(R.TECHNICAL_WORDS)}, b AS (SELECT id, {strip_sql('text')} AS t FROM prompts),
    c AS (SELECT id, t, length(t) AS n, {words_sql('t')} AS w, {_tech} AS tech, {_logic} AS logic, regexp_matches(t, '\\d|[;:()]') AS marks,
      len(regexp_extract_all(t, '[a-zA-Z]{{4,}}')) AS runs FROM b),
    s AS (SELECT *, len(w) AS k, len(list_distinct(w)) AS u FROM c)"""


@query(
    "complexity",
    f"""WITH {_cx}, p AS (SELECT *,
      (n > 160 OR k > 28)::INT + (u / k < 0.65)::INT + logic::INT + marks::INT + CASE WHEN tech >= 3 THEN 2 WHEN tech > 0 THEN 1 ELSE 0 END AS s1,
      (n > 120 OR k > 20)::INT + (u / (k + 1e-6) < 0.7)::INT + logic::INT AS s2 FROM s)
    SELECT id, CASE WHEN k = 0 OR (n < 45 AND tech = 0 AND NOT logic) THEN 'low' WHEN s1 >= 4 THEN 'high' WHEN s1 >= 2 THEN 'medium' ELSE 'low' END AS newest,
      CASE WHEN n < 40 AND runs < 5 AND tech = 0 AND NOT logic THEN 'low' WHEN s2 + (runs > 15 OR tech >= 3)::INT >= 2 THEN 'high' WHEN s2 + (runs > 15 OR tech >= 3)::INT = 1 THEN 'medium' ELSE 'low' END AS words_logic_terms,
      CASE WHEN s2 >= 2 THEN 'high' WHEN s2 = 1 THEN 'medium' ELSE 'low' END AS words_logic,
      CASE WHEN n < 40 AND runs < 5 AND tech = 0 THEN 'low' WHEN n < 120 AND runs < 15 AND tech < 3 THEN 'medium' ELSE 'high' END AS letters_terms FROM p""",
)
def complexity(spark, d):
    p = prompts(spark, d, R.TECHNICAL_WORDS)
    t = strip(F.col("text"))
    names = {"newest": "current", "words_logic_terms": "words_logic_terms", "words_logic": "words_logic", "letters_terms": "letters_terms"}
    return p.select("id", t.alias("t")).select("id", *[L.complexity(F.col("t"), v).alias(k) for k, v in names.items()])


CONTROL_CUES = R.ENERGY_WORDS + GUESS_CUES + PERSONA_CUES
_persona_first = (
    "CASE " + " ".join(f"WHEN {_persona_when(p).replace(chr(39) + chr(39), chr(39))} THEN {lit(p)}" for p in R.PERSONA_RULES)
    + f" WHEN {_generic} THEN 'customer support agent' ELSE 'helpful assistant' END"
)


@query(
    "effective_controls",
    f"""WITH {prompts_cte(CONTROL_CUES)}, s AS (SELECT id, text, {_energy_sql(R.ENERGY_WORDS)} AS energy_score, '' AS ctx,
      list_filter({words_sql('lower(text)')}, lambda w: length(w) > 2) AS kw FROM prompts),
    e AS (SELECT *, {_level_sql('energy_score')} AS energy_level FROM s)
    SELECT id, energy_level, energy_score, {first_sql('lower(text)', R.PLATFORM_GUESS, lit('corporate_website'))} AS platform,
      'support_page' AS touchpoint, CASE energy_level WHEN 'high' THEN 'long' WHEN 'medium' THEN 'medium' ELSE 'short' END AS answer_style,
      {_persona_first} AS age_group, CASE WHEN energy_level = 'high' THEN 'informal' ELSE 'formal' END AS greeting_style FROM e""",
)
def effective_controls(spark, d):
    return L.effective_controls(prompts(spark, d, CONTROL_CUES), "text", {"touchpoint": "default"}).drop("text", "n")


@query("analyze")
def analyze(spark, d):
    p = L.analyze(prompts(spark, d, TOPIC_CUES), "text")
    a = F.col("analysis")
    return p.select(
        "id", F.array_join(a["domain"], "|").alias("domain"), a["intent"].alias("intent"), a["tone"].alias("tone"),
        F.array_join(a["persona"], "|").alias("persona"), a["complexity"].alias("complexity"),
        a["context_summary"].alias("context_summary"),
    )


_OPS = list(R.OPERATIONAL_CONTEXTS)


@query(
    "operational_context",
    f"""WITH {TOPICS_CTE}, k AS (SELECT id, topics, list_filter(topics, lambda t: list_contains({arr(_OPS)}, t))[1] AS k FROM topics)
    SELECT id, {lookup_sql('k', R.OPERATIONAL_CONTEXTS, "'general'")} AS context, topics[1] AS newest FROM k""",
)
def operational_context(spark, d):
    p = prompts(spark, d, TOPIC_CUES).withColumn("t", L.topics(L.keywords(F.col("text")), _ctx()))
    return p.select(
        "id", L.operational_context(F.col("t")).alias("context"), L.operational_context(F.col("t"), True).alias("newest")
    )


@query("turn_profile")
def turn_profile(spark, d):
    p = prompts(spark, d, INDUSTRY_CUES + INTENT_CUES).withColumns(
        {"pf": cue(F.col("n"), PLATFORM_NAMES), "tp": cue(F.col("n"), TOUCHPOINT_NAMES)}
    )
    out = L.turn_profile(p, "text", F.col("pf"), F.col("tp"))
    return out.withColumn("keywords", F.array_join("keywords", " ")).drop("text", "n", "pf", "tp")


@query(
    "prompt_basics",
    "SELECT text AS prompt, length(text) AS length, array_to_string(regexp_extract_all(lower(text), '[a-z]{4,}'), ' ') AS keywords FROM documents",
)
def prompt_basics(spark, d):
    out = L.prompt_basics(table(spark, d, "documents"), "text")
    return out.withColumn("keywords", F.array_join("keywords", " "))


_given = cue_sql("n", ["", "gen x", "", "boomer", ""])
_age = first_sql("lower(text)", R.AGE_SLANG, "'millennial'")


@query(
    "age_group",
    f"""WITH {prompts_cte(AGE_CUES)}, g AS (SELECT id, coalesce(nullif({_given}, ''), {_age}) AS age FROM prompts)
    SELECT id, age, {lookup_sql('age', {k: v[0] for k, v in R.AGE_INFO.items()}, 'NULL')} AS persona, {lookup_sql('age', {k: v[1] for k, v in R.AGE_INFO.items()}, 'NULL')} AS tone FROM g""",
)
def age_group(spark, d):
    given = cue(F.col("n"), ["", "gen x", "", "boomer", ""])
    return prompts(spark, d, AGE_CUES).select("id", L.age_group(F.col("text"), given).alias("a")).select("id", "a.*")


