"""Labels from word lists: intent, domain, tone, topic, persona, energy, style, complexity.

All scorers test substrings of the lower-cased text, and ties go to the label listed first. Keyword lists are
fixed and short, so they are unrolled into plain boolean expressions that stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaforge.functions.common import (
    NOT_WS, WS, best_label, first_match, has_any, hits, let, lookup, strip, texts, words,
)
from qaforge.rules import lexicons as R
from qaforge.session import cut_lineage


def keywords(col: Column, mode: str = "word") -> Column:
    """Lower-cased tokens: alphabetic words over three letters, plain split, or runs of four ASCII letters."""
    if mode == "word":
        # A whole white-space separated piece: letters, with nothing but punctuation around them.
        mark = rf"[^\p{{L}}\p{{N}}{WS}]*+"
        return F.regexp_extract_all(
            F.lower(col), F.lit(rf"(?<!{NOT_WS}){mark}(\p{{L}}{{4,}}+){mark}(?!{NOT_WS})"), F.lit(1)
        )
    if mode == "space":
        return words(F.lower(col))
    if mode == "regex4":
        return F.regexp_extract_all(F.lower(col), F.lit(r"([a-z]{4,})"), F.lit(1))
    raise ValueError(f"unknown keyword mode: {mode}")


# Lexicons up to this size travel to the texts; words of a larger one are met by a join, the most frequent of them apart.
LEXICON_ROWS, LEXICON_BYTES, FREQUENT = 200_000, 8 << 20, 1000


def _valued(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens with the valence of the lexicon, null where it has none."""
    lex = lexicon.select("token", "valence")
    size = lex.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0)).alias("b")).first()
    if size["n"] <= LEXICON_ROWS and size["b"] <= LEXICON_BYTES:
        return tokens.join(F.broadcast(lex), "token", "left")
    # The row numbers must not move between the two parts, so they are written down first.
    tokens = cut_lineage(tokens)
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # At most FREQUENT tokens make up one in FREQUENT of all each.
    hot = F.broadcast(counts.filter(F.col("n") > F.lit(max(tokens.count() // FREQUENT, 1))).select("token"))
    rare = tokens.join(hot, "token", "left_anti").join(lex, "token", "left")
    return tokens.join(hot, "token", "left_semi").join(F.broadcast(lex.join(hot, "token", "left_semi")), "token", "left").unionByName(rare)


def sentiment(df: DataFrame, text: str, lexicon: DataFrame, id_col: str) -> DataFrame:
    """neg/neu/pos shares and the compound score from a caller's `lexicon(token, valence)`, a row per row of the table.

    Ids may be null or repeat: rows are told apart by their number. Tokens of one row are summed where they are read, so the shuffle carries
    one small row per text.
    """
    # The number is given below the explode, which would number tokens.
    rows = df.select(id_col, text, F.monotonically_increasing_id().alias("_row"))
    tokens = rows.select(
        id_col, "_row",
        F.explode_outer(
            F.transform(
                words(F.lower(F.col(text))),
                lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""),
            )
        ).alias("token"),
    )
    v = F.coalesce(F.col("valence"), F.lit(0.0))
    some = F.col("token").isNotNull() & (F.col("token") != "")
    sums = (
        _valued(tokens, lexicon)
        .groupBy("_row")
        .agg(
            F.first(id_col).alias(id_col),
            F.sum(v).alias("_s"),
            F.sum(F.when(v > 0, v + 1).otherwise(0.0)).alias("_p"),
            F.sum(F.when(v < 0, 1 - v).otherwise(0.0)).alias("_n"),
            F.sum(F.when(some & (v == 0), 1.0).otherwise(0.0)).alias("_u"),
        )
    )
    total = F.col("_p") + F.col("_n") + F.col("_u")

    def share(c: str) -> Column:
        return F.when(total > 0, F.round(F.col(c) / total, 3)).otherwise(F.lit(0.0))

    return sums.select(
        id_col,
        share("_n").alias("neg"),
        F.when(total > 0, F.round(F.col("_u") / total, 3)).otherwise(F.lit(1.0)).alias("neu"),
        share("_p").alias("pos"),
        F.round(F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + 15), 4).alias("compound"),
    )


def tone(compound: Column, second: Column | None = None) -> Column:
    """Five-way tone of one compound score or the mean of two."""
    c = compound if second is None else F.when(second.isNull(), compound).otherwise((compound + second) / 2)
    c = F.coalesce(c, F.lit(0.0))
    return (
        F.when(c > 0.5, "enthusiastic").when(c > 0.2, "positive").when(c < -0.5, "urgent")
        .when(c < -0.2, "negative").otherwise("neutral")
    )


def tone3(compound: Column, second: Column | None = None) -> Column:
    """Three-way tone with the older cut at 0.3."""
    c = compound if second is None else (compound + second) / 2
    c = F.coalesce(c, F.lit(0.0))
    return F.when(c > 0.3, "positive").when(c < -0.3, "negative").otherwise("neutral")


def _context(context: Column | str | None) -> Column:
    return F.lit(context) if context is None or isinstance(context, str) else context


def _generic(kw: Column) -> Column:
    return F.arrays_overlap(kw, texts(R.GENERIC_WORDS))


def _met(kw: Column, cues: Sequence[str]) -> Column:
    """The keywords that are cues at all; the rules ask these few, and each word of the text is looked up once."""
    return F.array_intersect(kw, texts(list(dict.fromkeys(cues))))


def topics(kw: Column, context: Column | str | None = None) -> Column:
    """All topics present as whole keywords, in table order, plus the generic three for product-like words."""
    ctx = _context(context)
    fallback = F.when(F.coalesce(ctx, F.lit("")) != "", F.array(ctx)).otherwise(texts(["general"]))

    def found(k: Column) -> Column:
        own = F.array_intersect(texts(list(R.TOPIC_TONES)), k)
        return F.when(_generic(k), F.array_union(own, texts(R.GENERIC_TOPICS))).otherwise(own)

    return let(_met(kw, [*R.TOPIC_TONES, *R.GENERIC_WORDS]), lambda k: let(found(k), lambda t: F.when(F.size(t) > 0, t).otherwise(fallback)))


def _persona_test(kw: Column, ctx: Column, persona: str) -> Column:
    contexts, cues = R.PERSONA_RULES[persona]
    test = F.arrays_overlap(kw, texts(cues))
    return (F.coalesce(ctx, F.lit("")).isin(contexts) | test) if contexts else test


def _persona_cues(names: Sequence[str]) -> list[str]:
    return [cue for p in names for cue in R.PERSONA_RULES[p][1]]


def personas(kw: Column, context: Column | str | None = None) -> Column:
    """All personas whose rule fires, in rule order, plus the generic three for product-like words."""
    ctx = _context(context)

    def found(k: Column) -> Column:
        own = F.array_compact(F.array(*[F.when(_persona_test(k, ctx, p), F.lit(p)) for p in R.PERSONA_RULES]))
        return F.when(_generic(k), F.array_union(own, texts(R.GENERIC_PERSONAS))).otherwise(own)

    return let(
        _met(kw, [*_persona_cues(list(R.PERSONA_RULES)), *R.GENERIC_WORDS]),
        lambda k: let(found(k), lambda p: F.when(F.size(p) > 0, p).otherwise(texts(["helpful assistant"])))
    )


def persona_single(kw: Column, context: Column | str | None = None) -> Column:
    """First of the four older persona rules that fires."""
    ctx = _context(context)

    def branches(k: Column) -> Column:
        out = F
        for p in R.SINGLE_PERSONAS:
            out = out.when(_persona_test(k, ctx, p), F.lit(p))
        return out.otherwise("helpful assistant")

    return let(_met(kw, _persona_cues(R.SINGLE_PERSONAS)), branches)


def topic_single(kw: Column, context: Column | str | None = None) -> Column:
    """First topic in table order, else the context, else general."""
    ctx = _context(context)
    found = F.array_intersect(texts(list(R.TOPIC_TONES)), kw)
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.nullif(ctx, F.lit("")), F.lit("general"))


def _rank(candidates: Column, scores: Column, order: Sequence[str]) -> Column:
    """Best candidate: highest score, then the fixed order, then the place in the list."""
    fixed = texts(order)
    rows = F.transform(
        candidates,
        lambda c, i: F.struct(
            (-F.coalesce(F.try_element_at(scores, i + 1), F.lit(0))).alias("s"),
            F.when(F.array_position(fixed, c) > 0, F.array_position(fixed, c)).otherwise(999).alias("o"),
            i.alias("i"),
            c.alias("v"),
        ),
    )
    return F.array_min(rows)["v"]


def rank_persona_topic(
    persona_list: Column, topic_list: Column, kw: Column, context: Column | str | None = None
) -> Column:
    """struct(persona, topic): the best of the first three personas and of the first two topics."""
    ctx = F.coalesce(_context(context), F.lit(""))
    joined = F.array_join(F.sort_array(F.array_distinct(kw)), " ")

    def fires(rules, ctx_col, lc):
        return [
            (targets, (has_any(lc, cues) | (ctx_col == (when or "\x00"))), points)
            for targets, when, cues, points in rules
        ]

    def score(c: Column, table) -> Column:
        total = F.lit(0)
        for targets, test, points in table:
            total = total + F.when(c.isin(targets) & test, points).otherwise(0)
        return total

    def pick(b: Column) -> Column:
        p_table, t_table = fires(R.PERSONA_SCORES, b["c"], b["l"]), fires(R.TOPIC_SCORES, b["c"], b["l"])
        bare_ctx = F.replace(b["c"], F.lit(" "), F.lit(""))
        p_list, t_list = F.slice(b["p"], 1, 3), F.slice(b["t"], 1, 2)
        p_scores = F.transform(
            p_list,
            lambda p: score(p, p_table)
            + F.when((b["c"] != "") & F.contains(bare_ctx, F.replace(p, F.lit(" "), F.lit(""))), 1).otherwise(0),
        )
        t_scores = F.transform(t_list, lambda t: score(t, t_table))
        return F.struct(
            let(p_scores, lambda s: _rank(p_list, s, R.PERSONA_ORDER)).alias("persona"),
            let(t_scores, lambda s: _rank(t_list, s, R.TOPIC_ORDER)).alias("topic"),
        )

    bound = F.struct(
        persona_list.alias("p"), topic_list.alias("t"), joined.alias("l"), ctx.alias("c")
    )
    return let(bound, pick)


def intent6(col: Column) -> Column:
    """Six-way intent; information when nothing matches."""
    return best_label(F.lower(col), R.INTENT6, "information")


def intent4(col: Column) -> Column:
    """Four-way intent; information when nothing matches."""
    return best_label(F.lower(col), R.INTENT4, "information")


def domain5(col: Column) -> Column:
    """Five-way domain; product when nothing matches."""
    return best_label(F.lower(col), R.DOMAIN5, "product")


def industry_label(col: Column) -> Column:
    return best_label(F.lower(col), R.INDUSTRY8, "general")


def _industry_info(label: Column) -> tuple[Column, Column]:
    return (
        lookup(label, {k: v[0] for k, v in R.INDUSTRY_INFO.items()}, "neutral"),
        lookup(label, {k: v[1] for k, v in R.INDUSTRY_INFO.items()}, "General"),
    )


def industry8(col: Column) -> Column:
    """struct(label, tone, description) of the best industry; general/neutral when nothing matches."""

    def info(label: Column) -> Column:
        tone_, description = _industry_info(label)
        return F.struct(label.alias("label"), tone_.alias("tone"), description.alias("description"))

    return let(industry_label(col), info)


def industry_first(col: Column) -> Column:
    """struct(domain, tone, intent, persona) of the first industry with any keyword."""

    def info(label: Column) -> Column:
        persona = F.when(label == "general", F.lit("helpful assistant")).otherwise(F.concat(label, F.lit(" expert")))
        return F.struct(
            label.alias("domain"),
            _industry_info(label)[0].alias("tone"),
            F.lit("information").alias("intent"),
            persona.alias("persona"),
        )

    return let(first_match(F.lower(col), R.INDUSTRY8, "general"), info)


def page_context_first(url: Column, html: Column) -> Column:
    """First context hit by the address or by the page; support when none is."""

    def branches(b: Column) -> Column:
        out = F
        for label, cues in R.CONTEXTS.items():
            out = out.when(has_any(b["u"], cues) | has_any(b["h"], cues), F.lit(label))
        return out.otherwise("support")

    bound = F.struct(F.lower(url).alias("u"), F.coalesce(F.lower(html), F.lit("")).alias("h"))
    return let(bound, branches)


def occurrences(lowered: Column, cue: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    gone = F.length(lowered) - F.length(F.replace(lowered, F.lit(cue), F.lit("")))
    return (gone / len(cue)).cast("int")


def page_context_counted(url: Column, text: Column) -> Column:
    """Address first; else the context whose words occur most often in the text; general when none does."""

    def total(t: Column, cues: Sequence[str]) -> Column:
        out = occurrences(t, cues[0])
        for cue in cues[1:]:
            out = out + occurrences(t, cue)
        return out

    by_text = best_label(F.coalesce(F.lower(text), F.lit("")), R.CONTEXTS, "general", total)
    return first_match(F.lower(url), R.CONTEXTS, by_text)


def context_message(context: Column) -> Column:
    """System message of a page context."""
    return lookup(context, R.CONTEXT_MESSAGES, R.CONTEXT_MESSAGES["general"])


def _contained_key(name: Column, keys: Sequence[str]) -> Column:
    return first_match(F.lower(name), {k: [k] for k in keys}, "")


def platform_info(name: Column) -> Column:
    """struct(tone, style, description) of the first platform whose key occurs in the name."""
    d_tone, d_desc, d_style = R.PLATFORM_DEFAULT

    def info(key: Column) -> Column:
        return F.struct(
            lookup(key, {k: v[0] for k, v in R.PLATFORMS.items()}, d_tone).alias("tone"),
            lookup(key, {k: v[2] for k, v in R.PLATFORMS.items()}, d_style).alias("style"),
            lookup(key, {k: v[1] for k, v in R.PLATFORMS.items()}, d_desc).alias("description"),
        )

    return let(_contained_key(name, list(R.PLATFORMS)), info)


def touchpoint_info(name: Column) -> Column:
    """struct(intent, description) of the first touchpoint whose key occurs in the name."""
    d_intent, d_desc = R.TOUCHPOINT_DEFAULT

    def info(key: Column) -> Column:
        return F.struct(
            lookup(key, {k: v[0] for k, v in R.TOUCHPOINTS.items()}, d_intent).alias("intent"),
            lookup(key, {k: v[1] for k, v in R.TOUCHPOINTS.items()}, d_desc).alias("description"),
        )

    return let(_contained_key(name, list(R.TOUCHPOINTS)), info)


def guess_platform(col: Column) -> Column:
    return first_match(F.lower(F.coalesce(col, F.lit(""))), R.PLATFORM_GUESS, "corporate_website")


def guess_touchpoint(col: Column) -> Column:
    return first_match(F.lower(F.coalesce(col, F.lit(""))), R.TOUCHPOINT_GUESS, "support_page")


def energy(col: Column, cues: Sequence[str] = tuple(R.ENERGY_WORDS)) -> Column:
    """struct(level, score): exclamation marks plus distinct energy words; an empty text is medium, 0."""
    text = F.coalesce(col, F.lit(""))

    def level(s: Column) -> Column:
        empty = text == ""
        return F.struct(
            F.when(empty, "medium").when(s >= 2, "high").when(s == 1, "medium").otherwise("low").alias("level"),
            F.when(empty, 0).otherwise(s).alias("score"),
        )

    marks = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    return let(F.lower(text), lambda low: let(marks + hits(low, list(cues)), level))


def energy_binary(col: Column) -> Column:
    """high when a case-sensitive mark occurs or the text is all upper case, else normal."""
    shouting = (F.upper(col) == col) & (F.lower(col) != col)
    return F.when(has_any(col, R.ENERGY_MARKS) | shouting, "high").otherwise("normal")


def energetic_tone(tone_col: Column, energy_col: Column) -> Column:
    """Tone with the suffix that high energy adds."""
    return F.when(energy_col == "high", F.concat(tone_col, F.lit(", enthusiastic"))).otherwise(tone_col)


def prompt_style(col: Column) -> Column:
    """Style of a prompt from ordered cue rules."""

    def rules(b: Column) -> Column:
        t, n = b["t"], b["n"]
        return (
            F.when(has_any(t, R.STYLE_TUTORIAL), "educational_tutorial")
            .when((n > 0) & (n <= 10) & ~has_any(t, R.STYLE_NOT_CONCISE), "direct_concise")
            .when(has_any(t, R.STYLE_CURIOUS), "curious_engaged")
            .when(has_any(t, R.STYLE_FRIENDLY), "friendly_conversational")
            .when(has_any(t, R.STYLE_PROFESSIONAL), "professional_clear")
            .otherwise("neutral")
        )

    bound = F.struct(F.lower(strip(col)).alias("t"), F.size(words(col)).alias("n"))
    return F.when(F.coalesce(col, F.lit("")) == "", "neutral").otherwise(let(bound, rules))


def technical_hits(col: Column, technical: Sequence[str] = tuple(R.TECHNICAL_WORDS)) -> Column:
    """Runs of four or more ASCII letters that are technical words, repeats counted."""
    runs = F.transform(F.regexp_extract_all(col, F.lit("([a-zA-Z]{4,})"), F.lit(1)), F.lower)

    def count(tokens: Column) -> Column:
        # Hashed set intersection first: most texts end there, and the rest is counted against a few words.
        return let(
            F.array_intersect(tokens, texts(list(technical))),
            lambda met: F.when(F.size(met) == 0, 0).otherwise(
                F.size(F.filter(tokens, lambda t: F.array_contains(met, t)))
            ),
        )

    return let(runs, count)


def complexity(col: Column, version: str = "current", technical: Sequence[str] = tuple(R.TECHNICAL_WORDS)) -> Column:
    """low, medium or high.

    `current` weighs length, vocabulary, logic words, digits and technical words; `words_logic_terms` is the
    version before it; `words_logic` has no technical words; `letters_terms` only counts letters and terms
    (its larger word list is the caller's to pass).
    """
    if version not in ("current", "words_logic_terms", "words_logic", "letters_terms"):
        raise ValueError(f"unknown complexity version: {version}")
    text = strip(F.coalesce(col, F.lit(""))) if version == "current" else F.coalesce(col, F.lit(""))

    def decide(b: Column) -> Column:
        n, tech, runs = b["n"], b["tech"], b["runs"]
        n_words, distinct, logic = b["words"], b["distinct"], b["logic"]
        if version == "current":
            score = (
                ((n > 160) | (n_words > 28)).cast("int")
                + (distinct / n_words < 0.65).cast("int")
                + logic.cast("int")
                + b["marks"].cast("int")
                + F.when(tech >= 3, 2).when(tech > 0, 1).otherwise(0)
            )
            plain = (n < 45) & (tech == 0) & ~logic
            graded = F.when(score >= 4, "high").when(score >= 2, "medium").otherwise("low")
            return F.when((n_words == 0) | plain, "low").otherwise(graded)
        if version == "letters_terms":
            return (
                F.when((n < 40) & (runs < 5) & (tech == 0), "low")
                .when((n < 120) & (runs < 15) & (tech < 3), "medium")
                .otherwise("high")
            )
        score = (
            ((n > 120) | (n_words > 20)).cast("int")
            + (distinct / (n_words + F.lit(1e-6)) < 0.7).cast("int")
            + logic.cast("int")
        )
        if version == "words_logic":
            low = n == 0
        else:
            score = score + ((runs > 15) | (tech >= 3)).cast("int")
            low = (n == 0) | ((n < 40) & (runs < 5) & (tech == 0) & ~logic)
        graded = let(score, lambda s: F.when(s >= 2, "high").when(s == 1, "medium").otherwise("low"))
        return F.when(low, "low").otherwise(graded)

    def measure(t: Column) -> Column:
        fields = {"n": F.length(t)}
        if version != "letters_terms":
            fields["logic"] = let(F.lower(t), lambda low: has_any(low, R.LOGIC_WORDS))
        if version == "current":
            fields["marks"] = t.rlike(r"\d|[;:()]")
        if version != "words_logic":
            fields["tech"] = technical_hits(t, technical)
        if version in ("words_logic_terms", "letters_terms"):
            fields["runs"] = F.regexp_count(t, F.lit("[a-zA-Z]{4,}"))

        def counted(w: Column) -> Column:
            sizes = {"words": F.size(w), "distinct": F.size(F.array_distinct(w))}
            return F.struct(*[c.alias(k) for k, c in {**fields, **sizes}.items()])

        if version == "letters_terms":
            return F.struct(*[c.alias(k) for k, c in fields.items()])
        return let(words(t), counted)

    return let(text, lambda t: let(measure(t), decide))


def operational_context(domains: Column, newest: bool = False) -> Column:
    """Context of the first known domain, else general; the newest rule takes the first domain as it is."""
    if newest:
        return F.coalesce(strip(F.try_element_at(domains, F.lit(1))), F.lit("general"))
    known = F.filter(domains, lambda d: d.isin(list(R.OPERATIONAL_CONTEXTS)))
    return F.coalesce(lookup(F.try_element_at(known, F.lit(1)), R.OPERATIONAL_CONTEXTS), F.lit("general"))


def age_group(col: Column, explicit: Column | str | None = None) -> Column:
    """struct(age, persona, tone): the given group, else the first one whose slang occurs, else millennial."""
    guess = first_match(F.lower(col), R.AGE_SLANG, "millennial")
    given = F.nullif(_context(explicit).cast("string"), F.lit(""))

    def info(g: Column) -> Column:
        return F.struct(
            g.alias("age"),
            lookup(g, {k: v[0] for k, v in R.AGE_INFO.items()}).alias("persona"),
            lookup(g, {k: v[1] for k, v in R.AGE_INFO.items()}).alias("tone"),
        )

    return let(F.coalesce(given, guess), info)


def effective_controls(df: DataFrame, text: str, settings: Mapping[str, str] | None = None) -> DataFrame:
    """Per prompt: energy, and each control as set (`auto`, `default` or a value)."""
    conf = {"platform": "auto", "touchpoint": "auto", "answer_style": "auto", "age_group": "auto", "greeting_style": "auto"}
    conf.update(settings or {})
    t = F.col(text)

    def control(name: str, auto: Column, default: str) -> Column:
        value = conf[name]
        return auto if value == "auto" else F.lit(default if value == "default" else value)

    e = F.col("_energy")
    by_energy = F.when(e["level"] == "high", "long").when(e["level"] == "medium", "medium").otherwise("short")
    plain_words = F.filter(words(F.lower(t)), lambda w: F.length(w) > 2)
    return (
        df.withColumn("_energy", energy(t))
        .withColumn("energy_level", e["level"])
        .withColumn("energy_score", e["score"])
        .withColumn("platform", control("platform", guess_platform(t), "corporate_website"))
        .withColumn("touchpoint", control("touchpoint", guess_touchpoint(t), "support_page"))
        .withColumn("answer_style", control("answer_style", by_energy, "medium"))
        .withColumn(
            "age_group", control("age_group", F.element_at(personas(plain_words), 1), "Corporate / Brand Voice")
        )
        .withColumn(
            "greeting_style",
            control("greeting_style", F.when(e["level"] == "high", "informal").otherwise("formal"), "formal"),
        )
        .drop("_energy")
    )


def _py_list(values: Column) -> Column:
    quoted = F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def analyze(df: DataFrame, text: str, compound: str | None = None, out: str = "analysis") -> DataFrame:
    """Add the full analysis record of a query; `compound` names a sentiment column, neutral without one."""
    t = F.col(text)
    kw = keywords(t)
    score = F.col(compound) if compound else F.lit(0.0)
    step = df.withColumns(
        {
            "_kw": kw,
            "_tone": tone(score),
            "_intent": intent6(t),
            "_complexity": complexity(t),
        }
    ).withColumns({"_topics": topics(F.col("_kw")), "_personas": personas(F.col("_kw"))})
    summary = F.concat(
        F.lit("Domains: "), _py_list(F.col("_topics")), F.lit(", Intent: "), F.col("_intent"), F.lit(", Tone: "),
        F.col("_tone"), F.lit(", Persona: "), _py_list(F.col("_personas")), F.lit(", Entities: [], Complexity: "),
        F.col("_complexity"),
    )
    record = F.struct(
        F.col("_topics").alias("domain"),
        F.col("_intent").alias("intent"),
        F.col("_tone").alias("tone"),
        F.col("_personas").alias("persona"),
        F.col("_complexity").alias("complexity"),
        texts([]).alias("entities"),
        summary.alias("context_summary"),
        F.lit("").alias("system_prompt"),
        F.create_map().cast("map<string,double>").alias("quality_scores"),
        F.lit("").alias("greeting"),
    )
    return step.withColumn(out, record).drop("_kw", "_tone", "_intent", "_complexity", "_topics", "_personas")


def turn_profile(
    df: DataFrame, text: str, platform: Column | str = "corporate_website",
    touchpoint: Column | str = "support_page", compound: str | None = None,
) -> DataFrame:
    """One row per prompt with every label of a chat turn and its first five keywords."""
    t = F.col(text)
    score = F.col(compound) if compound else F.lit(0.0)
    p_name = F.lit(platform) if isinstance(platform, str) else platform
    tp_name = F.lit(touchpoint) if isinstance(touchpoint, str) else touchpoint
    industry, p_info, tp_info = F.col("_i"), F.col("_p"), F.col("_t")
    return (
        df.withColumns(
            {
                "tone": tone(score),
                "intent": intent4(t),
                "domain": domain5(t),
                "prompt_style_key": prompt_style(t),
                "keywords": F.slice(keywords(t), 1, 5),
                "sentiment_compound": score,
                "platform": p_name,
                "touchpoint": tp_name,
                "_i": industry8(t),
                "_p": platform_info(p_name),
                "_t": touchpoint_info(tp_name),
            }
        )
        .withColumns(
            {
                "industry": industry["label"],
                "industry_description": industry["description"],
                "industry_default_tone": industry["tone"],
                "platform_tone": p_info["tone"],
                "platform_description": p_info["description"],
                "touchpoint_intent": tp_info["intent"],
                "touchpoint_description": tp_info["description"],
            }
        )
        .drop("_i", "_p", "_t")
    )


def prompt_basics(df: DataFrame, text: str) -> DataFrame:
    """Prompt, its length and its runs of four or more ASCII letters."""
    return df.select(
        F.col(text).alias("prompt"),
        F.length(text).alias("length"),
        keywords(F.col(text), "regex4").alias("keywords"),
    )


