"""Generation and its judgement, as far as it is data processing.

A language model is anything with ``complete(prompt, system)``; it runs in Python workers, one
batch at a time, and only on rows that need it.  What models return is parsed and aggregated
by Column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T

SYSTEM = "Answer from the given passages only. Be exact with numbers, and say so when they do not suffice."
TEMPLATE = (
    "Answer the question from the passages.\n"
    "State nothing that they do not state, and put the tag of the passage, in brackets as given, behind every fact.\n"
    "If they do not suffice, reply {sentinel} and say what is missing.\n\n"
    "PASSAGES:\n{context}\n\nQUESTION: {question}"
)


class LanguageModel(Protocol):
    def available(self) -> bool: ...

    def complete(self, prompt: str, system: str | None = None) -> str: ...


class ModelError(RuntimeError):
    """The model gave no usable response."""


class NullModel:
    """Stands for 'no model': never available, refuses every call."""

    def available(self) -> bool:
        return False

    def complete(self, prompt: str, system: str | None = None) -> str:
        raise ModelError("no language model is configured")


class ScriptedModel:
    """Returns the response of the first key that the prompt contains; for tests and dry runs."""

    def __init__(self, responses: dict[str, str], default: str | None = None):
        self.responses, self.default = responses, default

    def available(self) -> bool:
        return True

    def complete(self, prompt: str, system: str | None = None) -> str:
        for key, response in self.responses.items():
            if key in prompt:
                return response
        if self.default is None:
            raise ModelError("no scripted response")
        return self.default


class HttpModel:
    """Chat endpoint of a local model server, with retries; an empty body is a failure."""

    def __init__(self, model: str, host: str = "http://localhost:11434", context: int = 8192, max_tokens: int = 800, timeout: float = 300.0, attempts: int = 3, pause: float = 1.5, post=None):
        self.model, self.host, self.context, self.max_tokens = model, host.rstrip("/"), context, max_tokens
        self.timeout, self.attempts, self.pause, self._post = timeout, attempts, pause, post

    def _send(self, path: str, body: dict | None) -> dict:
        if self._post is not None:
            return self._post(path, body)
        from urllib.request import Request, urlopen

        request = Request(self.host + path, data=None if body is None else json.dumps(body).encode(), headers={"Content-Type": "application/json"})
        with urlopen(request, timeout=self.timeout) as response:
            return json.loads(response.read())

    def available(self) -> bool:
        try:
            names = [m.get("name", "") for m in self._send("/api/tags", None).get("models", [])]
        except Exception:
            return False
        return any(n == self.model or n.split(":")[0] == self.model for n in names)

    def _attempts(self, prompt: str, system: str | None, json_mode: bool, read: Callable[[str], Any]) -> Any:
        """What ``read`` makes of the first response that it accepts."""
        import time

        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        body = {"model": self.model, "messages": messages, "stream": False, "options": {"temperature": 0.0, "num_predict": self.max_tokens, "num_ctx": self.context}}
        if json_mode:
            body["format"] = "json"
        last: Exception | None = None
        for attempt in range(1, self.attempts + 1):
            try:
                text = (self._send("/api/chat", body).get("message") or {}).get("content", "")
                if text.strip():
                    return read(text)
                last = ModelError("empty response")
            except Exception as error:
                last = error
            if attempt < self.attempts:
                time.sleep(self.pause * attempt)
        raise ModelError(f"no response after {self.attempts} attempts: {last}")

    def complete(self, prompt: str, system: str | None = None) -> str:
        return self._attempts(prompt, system, False, str)

    def complete_json(self, prompt: str, system: str | None = None) -> Any:
        """A response that is cut off or no JSON is asked for again."""
        return self._attempts(prompt, system, True, read_json)


def read_json(text: str) -> Any:
    """The JSON in a response: fenced block, whole text, outermost braces, brackets."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    spans = [text[text.find(a) : text.rfind(b) + 1] for a, b in ("{}", "[]") if 0 <= text.find(a) < text.rfind(b)]
    for candidate in [*([fenced.group(1)] if fenced else []), text, *spans]:
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    raise ModelError(f"no JSON in {text[:80]!r}")


def ask_json(model: LanguageModel, prompt: str, system: str | None = None) -> Any:
    """In JSON mode where the model has one."""
    own = getattr(model, "complete_json", None)
    return own(prompt, system) if own else read_json(model.complete(prompt, system))


def with_responses(rows: DataFrame, prompts: dict[str, Column], model: LanguageModel, system: str | None = None) -> DataFrame:
    """For each name a column with the model's JSON response to that prompt, and ``<name>_error``.

    A null prompt is not asked; a response that fails leaves its own columns null and an error, and no others.
    """
    names, kinds = rows.columns, list(prompts)
    asked = rows.select("*", *[p.alias(f"__prompt_{n}") for n, p in prompts.items()])

    def one(prompt: str | None) -> tuple[str | None, str | None]:
        if prompt is None:
            return None, None
        try:
            return json.dumps(ask_json(model, prompt, system)), None
        except ModelError as error:
            return None, str(error)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = part[names].copy()
            for n in kinds:
                got = [one(p) for p in part[f"__prompt_{n}"]]
                out[n] = pd.Series([r for r, _ in got], dtype=object, index=part.index)
                out[f"{n}_error"] = pd.Series([e for _, e in got], dtype=object, index=part.index)
            yield out

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"{n} string, {n}_error string" for n in prompts]
    return asked.mapInPandas(run, ", ".join(fields))


def filled(template: str, **values: Column) -> Column:
    """A prompt template with columns for its ``{names}``."""
    return F.concat(*[values[p[1:-1]] if p[1:-1] in values and p[:1] == "{" else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p])


REWRITE = (
    "Write {n} other search queries for the question below: one in formal terms with names spelled out, one in everyday words, "
    'one about the exact quantity that is asked for. Do not answer it.\nReply with JSON: {"queries": ["...", "..."]}\n\nQUESTION: {question}'
)


def rewrite(queries: DataFrame, model: LanguageModel, max_queries: int = 3) -> DataFrame | None:
    """``queries(qid, query)`` to variants (qid, ordinal, query), as ``fusion.distinct_variants`` takes them beside the originals.

    None where no variant could be made: one query is enough, or there is no model.  A failure or a malformed
    response gives its question no variants; entries that are not text are passed over.
    """
    if max_queries <= 1 or not model.available():
        return None
    asked = with_responses(queries.select("qid", "query"), {"response": filled(REWRITE, n=F.lit(str(max_queries - 1)), question=F.col("query"))}, model)
    listed = F.from_json("response", "struct<queries:string>")["queries"]
    whole = F.when(F.substring(T.strip(F.col("response")), 1, 1) == "[", F.col("response")).otherwise(listed)
    raw = F.from_json(whole, "array<variant>")
    texts = F.transform(F.filter(raw, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    return asked.select("qid", F.posexplode(texts).alias("ordinal", "query")).where(F.length(T.strip(F.col("query"))) > 0).select("qid", "ordinal", T.strip(F.col("query")).alias("query"))


def build_model(provider: str, model: str = "", **options) -> LanguageModel:
    if provider == "null":
        return NullModel()
    if provider == "ollama":
        return HttpModel(model, **options)
    raise ValueError(f"unknown provider {provider!r}")


def prompt(question: Column, context: Column) -> Column:
    pieces = TEMPLATE.replace("{sentinel}", T.ABSTENTION_SENTINEL).replace("{context}", "\0c\0").replace("{question}", "\0q\0").split("\0")
    return F.concat(*[{"c": context, "q": question}.get(p, F.lit(p)) for p in pieces])


def answer(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """``rows(qid, question, context_text, valid_citations)`` with answer, citations, abstained, degenerate, error.

    Without context the answer is a refusal and the model is not called.
    """
    blank = F.length(T.strip(F.coalesce("context_text", F.lit("")))) == 0
    refusal = f"{T.ABSTENTION_SENTINEL}: nothing was found that bears on this question."
    empty = rows.where(blank).withColumn("answer", F.lit(refusal)).withColumn("error", F.lit(None).cast("string"))
    full = rows.where(~blank).withColumn("prompt", prompt(F.col("question"), F.col("context_text")))
    names = rows.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, errors = [], []
            for p in part["prompt"]:
                try:
                    texts.append(model.complete(p, SYSTEM).strip())
                    errors.append(None)
                except ModelError as e:
                    texts.append(None)
                    errors.append(str(e))
            yield part[names].assign(answer=pd.Series(texts, dtype=object, index=part.index), error=pd.Series(errors, dtype=object, index=part.index))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    asked = full.mapInPandas(run, f"{fields}, answer string, error string")
    both = asked.unionByName(empty)
    cited = F.when(blank, F.array().cast("array<string>")).otherwise(T.citations(F.coalesce("answer", F.lit("")), F.col("valid_citations")))
    return both.select("*", cited.alias("citations"), T.is_abstention(F.col("answer")).alias("abstained"), T.is_degenerate(F.col("answer")).alias("degenerate"))


CLAIMS = "struct<claims:array<struct<claim:string,verdict:string>>>"
SCORE = "struct<score:double>"
VERDICTS = "struct<verdicts:array<struct<index:int,useful:boolean>>>"


def faithfulness(response: Column) -> Column:
    """struct(score, n_claims, n_unsupported) of a judge's claims; anything but "supported" counts
    against the score, no claims score 1, and what cannot be parsed is null."""
    claims = F.coalesce(F.from_json(T.json_text(response), CLAIMS)["claims"], F.array().cast("array<struct<claim:string,verdict:string>>"))
    good = F.size(F.filter(claims, lambda c: F.lower(T.strip(F.coalesce(c["verdict"], F.lit("")))) == "supported"))
    n = F.size(claims)
    score = F.when(n == 0, F.lit(1.0)).otherwise(F.try_divide(good, n))
    return F.when(T.json_text(response).isNotNull(), F.struct(score.alias("score"), n.alias("n_claims"), (n - good).alias("n_unsupported")))


def relevance(response: Column) -> Column:
    """The judge's score, clamped to [0, 1]; null without a number."""
    score = F.from_json(T.json_text(response), SCORE)["score"]
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def context_precision(response: Column, n_passages: Column) -> Column:
    """Useful passages over passages ruled on; the first verdict on an index counts, indexes that do not
    exist are ignored; null without a usable verdict, 0 without passages."""
    verdicts = F.coalesce(F.from_json(T.json_text(response), VERDICTS)["verdicts"], F.array().cast("array<struct<index:int,useful:boolean>>"))
    valid = F.filter(verdicts, lambda v: v["index"].between(1, n_passages))
    indexes = F.array_distinct(F.transform(valid, lambda v: v["index"]))
    first = F.transform(indexes, lambda i: F.coalesce(F.element_at(F.filter(valid, lambda v: v["index"] == i), 1)["useful"], F.lit(False)))
    return F.when(n_passages == 0, F.lit(0.0)).otherwise(F.try_divide(F.size(F.filter(first, lambda u: u)), F.size(first)))


JUDGE_SYSTEM = "You grade answers. Be strict, and reply with JSON only."
CLAIMS_PROMPT = (
    "List each factual claim of the answer and say whether the passages support it.\n"
    'Reply with {"claims": [{"claim": "...", "verdict": "supported|unsupported|contradicted"}]}.\n\nPASSAGES:\n{context}\n\nANSWER:\n{answer}'
)
RELEVANCE_PROMPT = 'How well does the answer address the question, from 0 to 1? Reply with {"score": 0.0}.\n\nQUESTION: {question}\n\nANSWER:\n{answer}'
USEFUL_PROMPT = 'Say of each numbered passage whether it helps to answer the question. Reply with {"verdicts": [{"index": 1, "useful": true}]}.\n\nQUESTION: {question}\n\nPASSAGES:\n{passages}'
#: Characters of a passage that the judge of context sees.
PASSAGE_CHARS = 1200


def judge(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """``rows(qid, question_type, question, answer, answerable, context_text, passages)`` to item scores, by three judgements.

    Collapsed answers and refusals are not judged, and without passages nobody is asked which were useful.
    """
    asked = ~T.is_degenerate(F.col("answer")) & ~T.is_abstention(F.col("answer"))
    shown = F.array_join(F.transform("passages", lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(p, 1, PASSAGE_CHARS))), "\n\n")
    prompts = {
        "claims_json": F.when(asked, filled(CLAIMS_PROMPT, context=F.col("context_text"), answer=F.col("answer"))),
        "score_json": F.when(asked, filled(RELEVANCE_PROMPT, question=F.col("question"), answer=F.col("answer"))),
        "verdicts_json": F.when(asked & (F.size("passages") > 0), filled(USEFUL_PROMPT, question=F.col("question"), passages=shown)),
    }
    return score_items(with_responses(rows, prompts, model, JUDGE_SYSTEM).withColumn("n_passages", F.size("passages")))


def score_items(rows: DataFrame) -> DataFrame:
    """``rows(qid, question_type, answer, answerable, claims_json, score_json, verdicts_json, n_passages)`` to item scores.

    Collapsed answers have no scores at all; refusals are faithful and judged no further; each
    judge that fails leaves its own score null and an error.
    """
    degenerate, abstained = T.is_degenerate(F.col("answer")), T.is_abstention(F.col("answer"))
    judged = ~degenerate & ~abstained
    f = faithfulness(F.col("claims_json"))
    r, p = relevance(F.col("score_json")), context_precision(F.col("verdicts_json"), F.col("n_passages"))
    errors = F.array_compact(
        F.array(
            F.when(degenerate, F.lit("degenerate: the answer repeats one character")),
            F.when(judged & f.isNull(), F.lit("faithfulness: no usable response")),
            F.when(judged & r.isNull(), F.lit("relevance: no usable response")),
            F.when(judged & p.isNull(), F.lit("context_precision: no usable response")),
        )
    )
    return rows.select(
        "qid", "question_type", F.when(judged, f["score"]).when(abstained & ~degenerate, F.lit(1.0)).alias("faithfulness"), F.when(judged, r).alias("answer_relevance"),
        F.when(judged, p).alias("context_precision"), (abstained & ~degenerate).alias("abstained"), F.when(~degenerate, abstained != F.col("answerable")).alias("abstention_correct"),
        F.when(judged, F.coalesce(f["n_claims"], F.lit(0))).otherwise(0).alias("n_claims"), F.when(judged, F.coalesce(f["n_unsupported"], F.lit(0))).otherwise(0).alias("n_unsupported"),
        degenerate.alias("degenerate"), errors.alias("errors"),
    )


def aggregate_items(items: DataFrame) -> DataFrame:
    """Means that skip nulls; hallucination over answered items with claims, weighted by claims."""
    answered = ~F.col("abstained") & ~F.col("degenerate") & (F.col("n_claims") > 0)
    return items.agg(
        F.avg("faithfulness").alias("faithfulness"), F.avg("answer_relevance").alias("answer_relevance"), F.avg("context_precision").alias("context_precision"),
        F.avg(F.col("abstention_correct").cast("double")).alias("abstention_accuracy"),
        F.try_divide(F.sum(F.when(answered, F.col("n_unsupported"))), F.sum(F.when(answered, F.col("n_claims")))).alias("hallucination_rate"),
        F.count("*").alias("n_evaluated"), F.count_if(F.size("errors") > 0).alias("n_errors"), F.count_if("degenerate").alias("n_degenerate"),
    )


def rescore_abstention(answers: DataFrame) -> DataFrame:
    """``answers(qid, answer, answerable)``: refusals found again in stored answers, and whether right."""
    again = T.is_abstention(F.col("answer"))
    return answers.select("qid", again.alias("abstained"), (again != F.col("answerable")).alias("correct"))
