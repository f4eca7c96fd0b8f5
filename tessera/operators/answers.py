"""From hits to answers: the two gates, contexts and prompts, what came back, and its citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import Config, options
from tessera.functions import text as T
from tessera.providers import Generator, generate

LEAST_SCORE = 0.003
# Reasons of a refusal, the marks of a prompt's parts, its rules, and the verdicts of a judge.
NO_HITS, NO_ANSWER, NOT_THERE = "yeterli kaynak bulunamadı", "cevap üretilemedi", "cevap belgelerde yok"
DOCUMENTS_MARK, QUESTION_MARK = "BELGELER:", "SORU:"
RULES = f"Answer from the numbered documents alone and cite them as [n]. If they don't hold the answer, write {T.REFUSAL} and why."
RIGHT_MARKS, WRONG_MARKS = ("DOĞRU", "DOGRU"), ("YANLIŞ", "YANLIS")


def score_gate(questions: DataFrame, hits: DataFrame, query_id: str = "query_id", least: float = LEAST_SCORE) -> DataFrame:
    """The questions with top_score and refused: no hit, or the best one below `least`."""
    top = hits.where("rank = 1").select(query_id, F.col("score").alias("top_score"))
    return questions.join(top, query_id, "left").withColumn("refused", F.coalesce(F.col("top_score") < least, F.lit(True)))


def contexts(hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Rows (query_id, context): the hits in order of rank, each under its number, document and pages."""
    block = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("doc"), F.lit(" "), T.page_label(F.col("page_start"), F.col("page_end")), F.lit("\n"), F.col("text"))
    held = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy(query_id).agg(F.array_join(held["block"], "\n\n").alias("context"))


def prompts(questions: DataFrame, context: DataFrame, query_id: str = "query_id", question: str = "question") -> DataFrame:
    """The questions with `prompt`: rules, documents, question. A question without context gets none of the documents."""
    parts = [F.lit(f"{RULES}\n\n{DOCUMENTS_MARK}\n"), F.coalesce(F.col("context"), F.lit("")), F.lit(f"\n\n{QUESTION_MARK} "), F.coalesce(F.col(question), F.lit(""))]
    return questions.join(context, query_id, "left").withColumn("prompt", F.concat(*parts)).drop("context")


def grounding_gate(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """The answers with answer, refused and reason: refused are empty answers and those that hold the refusal mark anywhere."""
    text = T.without_thinking(F.coalesce(F.col(answer_col), F.lit("")))
    refused = (text == "") | text.contains(T.REFUSAL)
    why = F.when(text == "", NO_ANSWER).when(text.contains(T.REFUSAL), F.coalesce(F.nullif(T.stripped(F.replace(text, F.lit(T.REFUSAL), F.lit(""))), F.lit("")), F.lit(NOT_THERE)))
    return answers.withColumn("refused", refused).withColumn("reason", why).withColumn(answer_col, text)


def citations(answers: DataFrame, hits: DataFrame, query_id: str = "query_id", answer_col: str = "answer") -> DataFrame:
    """Rows (query_id, place, doc, page_start, page_end) of the hits that [n] marks name, each page once, in order."""
    marks = answers.select(query_id, F.posexplode(F.regexp_extract_all(F.col(answer_col), F.lit(r"\[(\d+)\]"), F.lit(1))).alias("place", "mark"))
    cited = marks.select(query_id, "place", F.expr("try_cast(mark as int)").alias("rank")).join(hits.select(query_id, "rank", "doc", "page_start", "page_end"), [query_id, "rank"])
    return cited.groupBy(query_id, "doc", "page_start").agg(F.min("place").alias("place"), F.min_by("page_end", "place").alias("page_end"))


def passages(hits: DataFrame, cited: DataFrame, query_id: str = "query_id", chars: int = 300) -> DataFrame:
    """The hits with `cited`, is their page among the citations, and a preview of their text."""
    marks = cited.select(query_id, "doc", "page_start", F.lit(True).alias("cited")).distinct()
    return hits.join(marks, [query_id, "doc", "page_start"], "left").withColumn("cited", F.coalesce("cited", F.lit(False))).withColumn("preview", T.preview(F.col("text"), chars))


def final_answers(gated: DataFrame, grounded: DataFrame, cited: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Rows (query_id, answer, refused, reason, sources): gated is refused before an answer was asked for, grounded after; sources are cited (doc, page) in order."""
    sources = cited.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("place", "doc", F.col("page_start").alias("page")))).alias("held"))
    sources = sources.select(query_id, F.transform("held", lambda s: F.struct(s["doc"].alias("doc"), s["page"].alias("page"))).alias("sources"))
    late = grounded.select(query_id, "answer", F.col("refused").alias("late"), F.col("reason").alias("why"))
    rows = gated.select(query_id, F.col("refused").alias("early")).join(late, query_id, "left").join(sources, query_id, "left")
    refused = F.col("early") | F.coalesce("late", F.lit(True))
    reason = F.when(F.col("early"), NO_HITS).when(refused, F.coalesce("why", F.lit(NO_ANSWER)))
    return rows.select(query_id, F.when(refused, "").otherwise(F.col("answer")).alias("answer"), refused.alias("refused"), reason.alias("reason"), F.when(refused, F.array().cast("array<struct<doc: string, page: int>>")).otherwise(F.coalesce("sources", F.array().cast("array<struct<doc: string, page: int>>"))).alias("sources"))


def answer_questions(questions: DataFrame, hits: DataFrame, provider: Generator, model: str = "turbo", config: Config = Config(), query_id: str = "query_id") -> DataFrame:
    """The whole way: gate by score, prompt, generate for what passed, gate by grounding, cite. hits carry doc, pages and text."""
    gated = score_gate(questions, hits, query_id, config.least_score)
    asked = prompts(gated.where("not refused"), contexts(hits, query_id), query_id)
    raw = generate(asked, provider, options(config.tiers.get(model, model), config))
    grounded = grounding_gate(raw.select(query_id, F.col("raw_answer").alias("answer")))
    return final_answers(gated, grounded, citations(grounded.where("not refused"), hits, query_id), query_id)


def folded_stream(deltas: DataFrame, query_id: str = "query_id", order: str = "seq") -> DataFrame:
    """Rows (query_id, answer, thinking_from, writing_from) of deltas (query_id, seq, content, thinking): the contents in order, and where either stage first shows."""
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.coalesce("content", F.lit("")).alias("content"))))
    return deltas.groupBy(query_id).agg(F.array_join(held["content"], "").alias("answer"), F.min(F.when(has("thinking"), F.col(order))).alias("thinking_from"), F.min(F.when(has("content"), F.col(order))).alias("writing_from"))


def may_become_refusal(shown: Column) -> Column:
    """Is a text that is still being written a beginning of the refusal mark, or does it begin with it?"""
    text = F.regexp_replace(shown, f"^{T.SPACE}+", "")
    return F.lit(T.REFUSAL).startswith(text) | text.startswith(T.REFUSAL)


def verdict(said: Column) -> Column:
    """right, wrong, or null: whichever mark of a judge comes first."""
    upper = F.upper(said)
    first = lambda marks: F.least(*(F.nullif(F.instr(upper, m), F.lit(0)) for m in marks))
    right, wrong = first(RIGHT_MARKS), first(WRONG_MARKS)
    return F.when(right.isNull() & wrong.isNull(), None).when(wrong.isNull() | (right < wrong), "right").otherwise("wrong")


def judge_answers(results: DataFrame, provider: Generator, options_: dict, question: str = "question", chars: int = 200) -> DataFrame:
    """The results with judge_verdict and judge_reason, the first `chars` characters of what the judge said in one line."""
    prompt = F.concat_ws("\n", F.col(question), F.coalesce("reference_answer", F.lit("")), F.coalesce("answer", F.lit("")))
    said = generate(results.withColumn("prompt", prompt), provider, options_, out="said").drop("prompt")
    line = F.left(F.regexp_replace(F.col("said"), r"\n", " "), F.lit(chars))
    return said.withColumn("judge_verdict", verdict(F.col("said"))).withColumn("judge_reason", line).drop("said")


def thinking_probe(prompts_: DataFrame, provider: Generator, options_: dict, query_id: str = "query_id") -> DataFrame:
    """Rows (query_id, on, off, same): answers with thinking forced on and off, less their thoughts."""
    sides = [generate(prompts_, provider, options_ | {"think": think}).select(query_id, T.without_thinking(F.col("raw_answer")).alias(name)) for name, think in (("on", True), ("off", False))]
    return sides[0].join(sides[1], query_id).withColumn("same", F.col("on") == F.col("off"))
