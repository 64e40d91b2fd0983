"""System prompts and training records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaforge.functions import labels as L
from qaforge.functions.common import LINE_BREAK, fill, let, lookup, strip, texts
from qaforge.operators.ranking import row_number_by
from qaforge.rules import lexicons as R
from qaforge.rules import templates as P


def message(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), (F.lit(content) if isinstance(content, str) else content).alias("content"))


def to_chat_records(
    qa: DataFrame, system: Column | str | None = P.DEFAULT_SYSTEM, q: str = "question", a: str = "answer", min_len: int = 0
) -> DataFrame:
    """Add `messages`: system (if any), user, assistant; blank sides and short answers are left out."""
    parts = [] if system is None else [message("system", system)]
    user, reply = strip(F.col(q)), strip(F.col(a))
    parts += [message("user", user), message("assistant", reply)]
    return qa.filter((user != "") & (reply != "") & (F.length(reply) >= min_len)).withColumn("messages", F.array(*parts))


def _persona_tone_line(persona: Column, tone: Column) -> Column:
    key = F.concat_ws("|", persona, tone)
    return lookup(key, {"|".join(k): v for k, v in P.PERSONA_TONE_LINES.items()})


def _opening(persona: Column, tone: Column, topic: Column) -> Column:
    sentence = fill(
        "You are a {persona} with a {tone} tone. Your expertise is in {topic}. "
        "Provide clear, accurate, and helpful answers to user questions.",
        persona=persona, tone=tone, topic=topic,
    )
    return F.coalesce(_persona_tone_line(persona, tone), lookup(topic, P.TOPIC_LINES), sentence)


def _unique_lines(lines_: Column) -> Column:
    kept = F.filter(F.transform(lines_, strip), lambda s: s.isNotNull() & (s != ""))
    return F.array_join(F.array_distinct(kept), "\n")


def system_prompt_for_pair(
    df: DataFrame, q: str = "question", a: str = "answer", context: str | None = None, version: str = "best",
    q_compound: str | None = None, a_compound: str | None = None, out: str = "system_prompt",
    persona_limit: int = 1, topic_limit: int = 1, keyword_mode: str = "word", instructions: bool = True,
) -> DataFrame:
    """Add a system prompt made from the labels of both texts and the page context.

    Versions: `best` (best persona and topic), `all` (all labels listed), `cross` (persona by topic), `plain` (first
    persona and topic in one sentence). Compounds name sentiment columns; neutral without them.
    """
    ctx = F.col(context) if context else F.lit(None).cast("string")
    extra = F
    for name, cues in R.CONTEXTS.items():
        extra = extra.when(ctx == name, texts(cues))
    extra = extra.otherwise(texts([]))
    c1 = F.col(q_compound) if q_compound else F.lit(0.0)
    c2 = F.col(a_compound) if a_compound else F.lit(0.0)
    kw = F.array_distinct(
        F.concat(L.keywords(F.col(q), keyword_mode), L.keywords(F.coalesce(F.col(a), F.lit("")), keyword_mode), extra)
    )
    tone = L.tone3(c1, c2) if version == "plain" else L.tone(c1, c2)
    step = df.withColumns({"_kw": kw, "_tone": tone})
    topics, personas, tone_col = L.topics(F.col("_kw"), ctx), L.personas(F.col("_kw"), ctx), F.col("_tone")
    if version == "best":
        step = step.withColumns({"_t": topics, "_p": personas}).withColumn(
            "_r", L.rank_persona_topic(F.col("_p"), F.col("_t"), F.col("_kw"), ctx)
        )
        base = F.concat(
            _opening(F.col("_r.persona"), tone_col, F.col("_r.topic")), F.lit("\n" + P.GUARDRAIL)
        )
        tail = "\n\n" + P.INSTRUCTION_BLOCK + "\n\nInstructions:\n" + P.SUPPLEMENT.replace("{age_group}", "millennial")
        prompt = F.concat(base, F.lit(tail)) if instructions else base
    elif version == "all":
        step = step.withColumns({"_t": topics, "_p": personas, "_i": L.intent6(F.col(q))})
        lead = F.coalesce(
            _persona_tone_line(F.col("_p")[0], tone_col),
            fill(
                "You are a {p} with a {t} tone. Provide clear, accurate, and helpful answers to user questions.",
                p=F.col("_p")[0], t=tone_col,
            ),
        )
        prompt = _unique_lines(
            F.array(
                lead,
                fill("Domains: {x}.", x=F.array_join("_t", ", ")),
                fill("Personas: {x}.", x=F.array_join("_p", ", ")),
                fill("Intent: {i}, Tone: {t}.", i=F.col("_i"), t=tone_col),
            )
        )
    elif version == "cross":
        step = step.withColumns({"_t": F.slice(topics, 1, max(1, topic_limit)), "_p": F.slice(personas, 1, max(1, persona_limit))})
        grid = F.flatten(
            F.transform("_p", lambda p: F.transform(F.col("_t"), lambda t: _opening(p, tone_col, t)))
        )
        prompt = _unique_lines(grid)
    elif version == "plain":
        prompt = fill(
            "You are a {p} with a some {t} tone. Your expertise is in {x}. "
            "Provide clear, accurate, and helpful answers to user questions.",
            p=L.persona_single(F.col("_kw"), ctx), t=tone_col, x=L.topic_single(F.col("_kw"), ctx),
        )
    else:
        raise ValueError(f"unknown version: {version}")
    return step.withColumn(out, prompt).select(*df.columns, out)


def with_history(df: DataFrame, conv: str, turn: str, text: str, n: int = 3, out: str = "history") -> DataFrame:
    """Add the texts of the n turns before each turn, oldest first; `turn` numbers a conversation without gaps.

    Each turn is sent to the n turns after it, so groups hold at most n texts however long a conversation is. A
    window over the conversation would put all of a long one into a single task. A turn stored more than once gives
    its smallest text.
    """
    one = df.groupBy(conv, turn).agg(F.min(text).alias("_t"))
    sent = one.select(
        conv, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_back"), F.col(turn).alias("_from"), "_t"
    ).select(conv, (F.col("_from") + F.col("_back")).alias(turn), F.struct(F.col("_from"), F.col("_t")).alias("_h"))
    past = sent.groupBy(conv, turn).agg(F.array_sort(F.collect_list("_h"))["_t"].alias(out))
    return df.join(past, [conv, turn], "left").withColumn(out, F.coalesce(out, texts([])))


def system_prompt(
    df: DataFrame, mode: str = "full", domain: str = "domain", tone: str = "tone", intent: str = "intent",
    persona: str = "persona", summary: str | None = None, style: str | None = None, history: str | None = None,
    energy: str | Column = "normal", age_group: str | Column = "millennial", out: str = "system_prompt",
) -> DataFrame:
    """Add a minimal, compact or full system prompt from label columns (domain and persona are arrays)."""
    first = F.coalesce(F.try_element_at(F.col(domain), F.lit(1)), F.lit("general"))
    tone_c = F.coalesce(F.col(tone), F.lit("neutral"))
    intent_c = F.coalesce(F.col(intent), F.lit("information"))
    people = F.array_join(persona, ", ")
    notes = strip(F.coalesce(F.col(summary), F.lit(""))) if summary else F.lit("")
    style_key = F.col(style) if style else F.lit("neutral")
    label = lookup(style_key, {k: v[0] for k, v in P.STYLE_LINES.items()}, P.STYLE_LINES["neutral"][0])
    line = lookup(style_key, {k: v[1] for k, v in P.STYLE_LINES.items()}, P.STYLE_LINES["neutral"][1])
    if mode == "minimal":
        prompt = fill(P.MINIMAL_PROMPT, domain=first, intent=intent_c, tone=tone_c)
    elif mode == "compact":
        prompt = F.concat_ws(
            "\n",
            F.lit("System role: Adaptive assistant"),
            fill("Domain: {x}", x=first),
            fill("Intent: {x}", x=intent_c),
            fill("Tone: {x}", x=tone_c),
            fill("Persona: {x}", x=people),
            F.when(notes != "", fill("Context: {x}", x=notes)),
            fill("Prompt Style: {x}", x=label),
            F.lit(P.COMPACT_RULES),
        )
    elif mode == "full":
        prompt = fill(
            P.FULL_PROMPT,
            domain=strip(first), energy=energy, age_group=age_group, style_label=label, style_line=line,
            personas=people,
            summary=F.when(notes != "", notes).otherwise("General context"),
            domain_line=lookup(first, P.DOMAIN_LINES, P.DOMAIN_DEFAULT),
            tone_line=lookup(tone_c, P.TONE_LINES, P.TONE_DEFAULT),
            intent_line=lookup(intent_c, P.INTENT_LINES, P.INTENT_DEFAULT),
        )
        if history:
            prompt = _add_history(prompt, F.col(history))
    else:
        raise ValueError(f"unknown mode: {mode}")
    return df.withColumn(out, prompt)


def _add_history(prompt: Column, history: Column) -> Column:
    n = F.size(history)
    last = F.slice(history, F.greatest(n - 2, F.lit(1)), F.lit(3))
    line = F.concat(F.lit("\nContextual history: "), F.array_join(last, " | "))
    return F.when(n > 0, F.concat(prompt, line)).otherwise(prompt)


def dimension_prompt(
    df: DataFrame, template: str, domain: str = "domain", tone: str = "tone", intent: str = "intent",
    persona: str | None = None, summary: str | None = None, history: str | None = None, analysis: str | None = None,
    body: str = "", guidance: str = "", energy: str | Column = "normal", age_group: str | Column = "millennial",
    out: str = "system_prompt",
) -> DataFrame:
    """Add a prompt in one of the older layouts.

    `three_dimension`, `adaptive` (scalar domain), `merged`, `layered` (array domain and persona; `body` is the
    caller's long middle part), `analysis` (an analysis JSON column with defaults per missing key; `guidance` is the
    caller's block after the guidelines).
    """
    if template == "three_dimension":
        prompt = fill(
            P.THREE_DIMENSION_PROMPT,
            domain_line=lookup(F.col(domain), P.THREE_DIMENSION_DOMAINS, P.OLD_DEFAULTS[0]),
            tone_line=lookup(F.col(tone), P.THREE_DIMENSION_TONES, P.OLD_DEFAULTS[1]),
            intent_line=lookup(F.col(intent), P.THREE_DIMENSION_INTENTS, P.OLD_DEFAULTS[2]),
        )
    elif template == "adaptive":
        prompt = fill(
            P.ADAPTIVE_PROMPT,
            domain=F.col(domain),
            domain_line=lookup(
                F.col(domain), {k: P.DOMAIN_LINES[k] for k in P.ADAPTIVE_DOMAINS}, P.DOMAIN_LINES["product"]
            ),
            tone_line=lookup(F.col(tone), {k: P.TONE_LINES[k] for k in P.ADAPTIVE_TONES}, P.OLD_DEFAULTS[1]),
            intent_line=lookup(F.col(intent), P.INTENT_LINES, P.OLD_DEFAULTS[2]),
        )
    elif template in ("merged", "layered"):
        first = F.coalesce(F.try_element_at(F.col(domain), F.lit(1)), F.lit("general" if template == "layered" else "product"))
        people = F.array_join(persona, ", ") if persona else F.lit("")
        notes = F.coalesce(F.nullif(F.col(summary), F.lit("")), F.lit("General context")) if summary else "General context"
        operational = L.operational_context(F.col(domain))
        merged = fill(
            P.MERGED_PROMPT,
            domain_line=lookup(first, P.DOMAIN_LINES, P.OLD_DEFAULTS[0]),
            tone_line=lookup(F.col(tone), P.TONE_LINES, P.OLD_DEFAULTS[1]),
            intent_line=lookup(F.col(intent), P.INTENT_LINES, P.OLD_DEFAULTS[2]),
            personas=F.when(people == "", "helpful assistant").otherwise(people),
            energy=energy, age_group=age_group, summary=notes,
            operational_context=L.operational_context(F.array(first)) if template == "layered" else operational,
        )
        prompt = merged
        if template == "layered":
            head = fill(
                P.LAYERED_HEAD, personas=people, domains=F.array_join(domain, ", "), tone=F.col(tone),
                intent=F.col(intent), operational_context=operational,
            )
            prompt = F.concat(head, F.lit(body), merged)
            if history:
                prompt = _add_history(prompt, F.col(history))
    elif template == "analysis":
        values = {
            k: F.coalesce(F.get_json_object(F.col(analysis), f"$.{k}"), F.lit(v)) for k, v in P.ANALYSIS_DEFAULTS.items()
        }
        middle = guidance.replace("{age_group}", "{Target_age_group}")
        prompt = strip(fill(P.ANALYSIS_HEAD + "\n" + middle + "\n" + P.ANALYSIS_TAIL, **values))
    else:
        raise ValueError(f"unknown template: {template}")
    return df.withColumn(out, prompt)


def answer_guidance(style: Column, age_group: Column | str = "millennial", older: bool = False) -> Column:
    """Word-range text for an answer style, medium by default."""
    table, tail = (P.ANSWER_GUIDANCE_OLD, P.ANSWER_GUIDANCE_OLD_TAIL) if older else (P.ANSWER_GUIDANCE, P.ANSWER_GUIDANCE_TAIL)
    return F.concat(lookup(F.lower(style), table, table["medium"]), fill(tail, age_group=age_group))


def guideline_sections(prompt: Column, heads: Sequence[str] = tuple(P.GUIDELINE_HEADS)) -> Column:
    """Only the named sections of a prompt, each from its heading to the next named one."""

    def cut(rows: Column) -> Column:
        is_head = F.transform(rows, lambda r: strip(r).isin(list(heads)))
        starts = F.filter(F.transform(is_head, lambda h, i: F.when(h, i)), lambda i: i.isNotNull())

        def section(at: Column) -> Column:
            def one(s: Column, k: Column) -> Column:
                end = F.coalesce(F.try_element_at(at, k + 2), F.size(rows))
                rest = F.array_join(F.slice(rows, s + 2, end - s - 1), "\n")
                return F.concat(strip(F.element_at(rows, s + 1)), F.lit("\n"), strip(rest))

            return F.array_join(F.transform(at, one), "\n\n")

        return let(starts, section)

    return let(F.split(F.coalesce(prompt, F.lit("")), LINE_BREAK), cut)


def feedback_prompt(prompt: Column, scores: Mapping[str, Column]) -> Column:
    """Append a sentence per low score; a missing score counts as good."""
    added = F.concat_ws(
        "\n", *[F.when(scores[k] < limit, F.lit(line)) for k, limit, line in P.FEEDBACK_LINES if k in scores]
    )
    base = F.coalesce(prompt, F.lit(""))
    joint = F.when((base != "") & ~base.endswith("\n"), F.lit("\n")).otherwise("")
    return F.when(added == "", base).otherwise(F.concat(base, joint, added))


def greeting_list(tone: Column, platform: Column | None = None, age_group: Column | None = None) -> Column:
    """Greetings that fit tone, platform and age group, without repeats."""
    t = F.lower(strip(F.coalesce(tone, F.lit("neutral"))))
    base = F
    for name, values in P.GREETINGS.items():
        base = base.when(t == name, texts(values))
    base = base.otherwise(texts(P.GREETINGS["neutral"]))
    parts = [base]
    if platform is not None:
        extra = F
        for cues, values in P.GREETING_PLATFORMS:
            test = F.lit(False)
            for cue in cues:
                test = test | F.contains(F.lower(platform), F.lit(cue))
            extra = extra.when(test, texts(values))
        parts.append(extra.otherwise(texts([])))
    if age_group is not None:
        extra = F
        for ages, tones, values in P.GREETING_AGES:
            extra = extra.when(F.lower(age_group).isin(ages) & t.isin(tones), texts(values))
        parts.append(extra.otherwise(texts([])))
    return F.array_distinct(F.concat(*parts))


def with_greeting(
    df: DataFrame, response: str, tone: str, id_col: str, seed: int = 0, energy: str | None = None,
    platform: str | None = None, age_group: str | None = None, prompt: str | None = None, mimic: bool = False,
    pick: Column | None = None, out: str = "greeted",
) -> DataFrame:
    """Add the response behind a greeting chosen by a seeded hash (or a given number).

    With `mimic`, low energy drops it for short or asking prompts, medium energy keeps it for formal tones only and
    high energy makes it exclaim.
    """
    options = greeting_list(F.col(tone), F.col(platform) if platform else None, F.col(age_group) if age_group else None)
    number = pick if pick is not None else F.xxhash64(F.col(id_col), F.lit(seed))
    level = F.lower(strip(F.coalesce(F.col(energy), F.lit("medium")))) if energy else F.lit("medium")
    asked = strip(F.coalesce(F.col(prompt), F.lit(""))) if prompt else F.lit("")
    body = F.col(response)

    def say(g: Column) -> Column:
        return strip(F.concat(g, F.lit(" "), body))

    def greet(opts: Column) -> Column:
        chosen = F.element_at(opts, (F.pmod(number, F.size(opts)) + 1).cast("int"))
        calm = F.replace(chosen, F.lit("!"), F.lit("."))
        loud = F.when(chosen.endswith("!"), chosen).otherwise(
            F.concat(F.regexp_replace(chosen, r"\.+$", ""), F.lit("!"))
        )
        plain = F.when(level == "high", say(loud)).when(level == "low", say(calm)).otherwise(say(chosen))
        if not mimic:
            return plain
        formal = F.lower(strip(F.col(tone))).isin("professional", "formal", "neutral")
        return (
            F.when((level == "low") & (asked.endswith("?") | (F.length(asked) < 60)), body)
            .when(level == "low", say(calm))
            .when((level == "medium") & formal, say(calm))
            .when(level == "medium", body)
            .when(level == "high", say(loud))
            .otherwise(plain)
        )

    return df.withColumn(out, let(options, greet))


def analysis_json(analysis: Column) -> Column:
    """Compact JSON of an analysis record."""
    return F.to_json(
        F.struct(
            analysis["domain"].alias("domain"),
            analysis["intent"].alias("intent"),
            analysis["persona"].alias("persona"),
            analysis["tone"].alias("tone"),
            L.operational_context(analysis["domain"], newest=True).alias("context"),
            analysis["system_prompt"].alias("system_prompt"),
            analysis["greeting"].alias("greeting"),
        )
    )


# ---------------------------------------------------------------- synthetic records


def _hash_pick(options: Column, *parts: Column | int | str) -> Column:
    number = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.element_at(options, (F.pmod(number, F.size(options)) + 1).cast("int"))


def synth_grid(
    domains: DataFrame, touchpoints: DataFrame, platforms: DataFrame, questions: DataFrame, seed: int = 0
) -> DataFrame:
    """One row per domain, touchpoint and platform with one of the domain's questions and the system text.

    `domains(domain, tone)`, `touchpoints(touchpoint, intent, description)`, `platforms(platform, tone, style)`,
    `questions(domain, pos, question)`. The three label tables are rule tables of a few rows each; they are folded
    into arrays so that the grid grows from the domains by explode.
    """
    tps = touchpoints.agg(F.array_sort(F.collect_list(F.struct("touchpoint", "intent", "description"))).alias("tps"))
    pls = platforms.agg(F.array_sort(F.collect_list(F.struct("platform", F.col("tone").alias("platform_tone"), "style"))).alias("pls"))
    # A question per cell is drawn by number, so a domain's questions are never gathered into one row.
    numbered = questions.select("domain", F.col("pos").cast("long").alias("_no"), "question")
    counts = numbered.groupBy("domain").agg(F.count(F.lit(1)).alias("_n"))
    one = F.lit(1)
    cells = (
        domains.withColumn("_one", one)
        .join(F.broadcast(tps.withColumn("_one", one)), "_one")
        .join(F.broadcast(pls.withColumn("_one", one)), "_one")
        .withColumn("tp", F.explode("tps"))
        .withColumn("pl", F.explode("pls"))
        .select("domain", "tone", "tp.touchpoint", "tp.intent", F.col("tp.description").alias("touchpoint_description"), "pl.platform", "pl.platform_tone", "pl.style")
        .join(counts, "domain", "left")
        .withColumn("_no", F.pmod(F.xxhash64("domain", "touchpoint", "platform", F.lit(seed)), F.col("_n")))
    )
    picked = cells.join(numbered, ["domain", "_no"], "left").withColumn(
        "question", F.coalesce("question", F.lit(P.GRID_FALLBACK_QUESTION))
    )
    return grid_system(picked).drop("_no", "_n")


def grid_system(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "system",
        fill(
            P.GRID_SYSTEM,
            domain_words=F.replace(F.col("domain"), F.lit("_"), F.lit(" ")), tone=F.col("tone"), style=F.col("style"),
            touchpoint_description=F.col("touchpoint_description"),
        ),
    )


def answer_for(
    asked: DataFrame, keys: DataFrame, answers: DataFrame, id_col: str = "id", seed: int = 0
) -> DataFrame:
    """Add an answer to each (domain, question): one of those of the first key whose word the question contains.

    `keys(domain, ord, word, key)` in order of preference, the first key being the default;
    `answers(domain, key, pos, answer)` with `pos` counting from 0. Without an answer a fallback sentence is given.
    The keys of a domain are few and folded into one row; answers are fetched by number.
    """
    menu = keys.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("ord", "word", "key"))).alias("_menu"))
    low = F.lower("question")
    hit = F.filter("_menu", lambda m: F.contains(low, m["word"]))
    key = F.coalesce(F.try_element_at(hit, F.lit(1))["key"], F.try_element_at(F.col("_menu"), F.lit(1))["key"])
    counts = answers.groupBy("domain", "key").agg(F.count(F.lit(1)).alias("_n"))
    cap = F.concat(F.upper(F.substr("question", F.lit(1), F.lit(1))), F.lower(F.substr("question", F.lit(2))))
    return (
        asked.join(menu, "domain", "left")
        .withColumn("key", key)
        .drop("_menu")
        .join(counts, ["domain", "key"], "left")
        .withColumn("pos", F.pmod(F.xxhash64(id_col, F.lit(seed)), F.col("_n")).cast("long"))
        .join(answers.withColumn("pos", F.col("pos").cast("long")), ["domain", "key", "pos"], "left")
        .withColumn("answer", F.coalesce("answer", fill(P.GRID_FALLBACK_ANSWER, question=cap)))
        .select(*asked.columns, "key", "answer")
    )


def add_diverse(
    n: int, domains: DataFrame, touchpoints: DataFrame, platforms: DataFrame, questions: DataFrame, seed: int = 0
) -> DataFrame:
    """n extra rows, each with a hash-drawn domain, touchpoint, platform and question.

    Domains, touchpoints and platforms are small menus, held in a row each; questions may be any number, so they are numbered and joined.
    """
    spark = domains.sparkSession
    one = F.lit(1)

    def menu(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name)).withColumn("_one", one)

    rows = spark.range(n).withColumn("_one", one)
    for df, cols, name in (
        (domains, ["domain", "tone"], "_d"),
        (touchpoints, ["touchpoint", "intent", "description"], "_t"),
        (platforms.withColumnRenamed("tone", "platform_tone"), ["platform", "platform_tone", "style"], "_p"),
    ):
        rows = rows.join(F.broadcast(menu(df, cols, name)), "_one").withColumn(
            name, _hash_pick(F.col(name), F.col("id"), name, seed)
        )
    asked = row_number_by(questions.select("question").withColumn("_one", one), ["_one"], [F.col("question")], "_drawn").drop("_one")
    total = questions.count()
    drawn = F.pmod(F.xxhash64("id", F.lit("_q"), F.lit(seed)), F.lit(total)) + 1 if total else F.lit(None).cast("long")
    flat = rows.withColumn("_drawn", drawn).join(asked, "_drawn", "left").select(
        "id", "_d.domain", "_d.tone", "_t.touchpoint", "_t.intent", F.col("_t.description").alias("touchpoint_description"),
        "_p.platform", "_p.platform_tone", "_p.style", "question",
    )
    return grid_system(flat)


def split_by_domain(records: DataFrame, phrase: str, messages: str = "messages") -> DataFrame:
    """Records whose system text contains the phrase."""
    return records.filter(F.contains(F.lower(F.try_element_at(F.col(messages), F.lit(1))["content"]), F.lit(phrase)))


def corpus_stats(df: DataFrame, domain: str = "domain", intent: str = "intent", tone: str = "tone") -> DataFrame:
    """One row: records and how many domains, intents and tones they span."""
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct(domain).alias("domains"),
        F.count_distinct(intent).alias("intents"),
        F.count_distinct(tone).alias("tones"),
    )


def first_system_prompt(records: DataFrame, file: str = "file", line: str = "line", messages: str = "messages") -> DataFrame:
    """First system message per file, else the default text."""
    own = F.try_element_at(F.filter(F.col(messages), lambda m: m["role"] == "system"), F.lit(1))["content"]
    place = F.when(own.isNotNull(), F.col(line))
    return records.groupBy(file).agg(
        F.coalesce(F.min_by(own, place), F.lit(P.DEFAULT_SYSTEM)).alias("system_prompt")
    )
