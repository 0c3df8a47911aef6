"""Optional help of a language model: prompts, a provider registry, and salvage of its answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestry.functions.extract import FIELDS

#: A provider takes a prompt and returns its answer; none is registered by default.
PROVIDERS: dict[str, Callable[[str], str]] = {}
#: What an unknown name stands for.
FALLBACK = "ollama"


def register_provider(name: str, ask: Callable[[str], str]) -> None:
    PROVIDERS[name] = ask


def provider_for(name: str | None = None) -> tuple[str, Callable[[str], str]]:
    """The provider of a name and what it is called; an unknown one is replaced by :data:`FALLBACK`."""
    if name in PROVIDERS:
        return name, PROVIDERS[name]
    if name == "huggingface":
        return name, HuggingFace()
    if name == "openai":
        return name, openai_compatible("gpt-4o-mini", "https://api.openai.com")
    return FALLBACK, PROVIDERS.get(FALLBACK) or ollama()


def _post(url: str, body: dict, headers: dict, timeout: float) -> dict:
    from urllib.request import Request, urlopen

    request = Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


def ollama(model: str = "llama3.1:8b", url: str = "http://localhost:11434", timeout: float = 60) -> Callable[[str], str]:
    """A provider that speaks to an Ollama server."""

    def answer(text: str) -> str:
        options = {"temperature": 0.1, "num_predict": 2048}
        return _post(f"{url}/api/generate", {"model": model, "prompt": text, "stream": False, "options": options}, {}, timeout).get("response", "")

    return answer


def openai_compatible(model: str, url: str, key: str = "", timeout: float = 60) -> Callable[[str], str]:
    """A provider that speaks to any server with the chat completions interface."""

    def answer(text: str) -> str:
        body = {"model": model, "messages": [{"role": "user", "content": text}], "temperature": 0.1, "max_tokens": 2048}
        got = _post(f"{url}/v1/chat/completions", body, {"Authorization": f"Bearer {key}"} if key else {}, timeout)
        return got["choices"][0]["message"]["content"]

    return answer


class HuggingFace:
    """A local causal model; loaded in the worker that first asks it, and not pickled."""

    def __init__(self, model: str = "llama3.1:8b", max_tokens: int = 512):
        self.model, self.max_tokens = model, max_tokens

    def __getstate__(self):
        return {"model": self.model, "max_tokens": self.max_tokens}

    def __call__(self, text: str) -> str:
        if "_loaded" not in self.__dict__:
            from transformers import AutoModelForCausalLM, AutoTokenizer

            self._loaded = AutoTokenizer.from_pretrained(self.model), AutoModelForCausalLM.from_pretrained(self.model, torch_dtype="auto")
        tokenizer, model = self._loaded
        ids = model.generate(tokenizer(text, return_tensors="pt").input_ids, max_new_tokens=self.max_tokens, do_sample=False)
        answer = tokenizer.decode(ids[0], skip_special_tokens=True)
        return answer.split(text, 1)[1].strip() if text in answer else answer


def prompt(t: Column) -> Column:
    """Asks for one JSON object with the fields of the fitting record type."""
    shapes = "\n".join(
        f"{kind}: " + ", ".join([*(name for name, _, _ in fields), *(["age"] if kind == "death" else [])]) for kind, fields in FIELDS.items()
    )
    head = (
        "Извлеки данные из записи метрической книги. Ответь одним объектом JSON с ключом record_type и полями этого типа, "
        'каждое в виде {"value": "...", "confidence": 0.0}; чего нет, то "Unknown". Даты пиши как YYYY-MM-DD.\n'
        f"{shapes}\nТекст:\n"
    )
    return F.concat(F.lit(head), t)


#: Fields that are looked for one by one in an answer that doesn't parse, with this confidence.
SALVAGED = ["child_name", "father_name", "mother_name", "deceased_name", "groom_name", "bride_name", "birth_date", "death_date", "marriage_date"]
SALVAGED_CONFIDENCE = 0.5
_TYPE = r'"record_type"\s*:\s*"([^"]+)"'


def _field(name: str) -> str:
    return rf'"{name}"\s*:\s*\{{"value"\s*:\s*"([^"]+)"'


def _typed(text: str) -> dict | None:
    try:
        got = json.loads(text)
    except ValueError:
        return None
    return got if "record_type" in got else None


def salvage(response: str | None) -> dict | None:
    """The record in an answer: a flat object, else the rest from the first brace with braces added, else single fields."""
    response = response or ""
    for m in re.finditer(r"\{[^{}]*\}", response):
        if got := _typed(m[0]):
            return got
    _, brace, rest = response.partition("{")
    if not brace:
        return None
    rest = brace + rest
    rest += "}" * max(0, rest.count("{") - rest.count("}"))
    if got := _typed(rest):
        return got
    kind = re.search(_TYPE, rest)
    if not kind:
        return None
    fields = {f: {"value": m[1], "confidence": SALVAGED_CONFIDENCE} for f in SALVAGED if (m := re.search(_field(f), rest))}
    return {"record_type": kind[1], **fields} if fields else None


def salvage_fields(response: Column) -> dict[str, Column]:
    """The last way of :func:`salvage` alone, without Python: a column for the type and for each field."""
    out = {"record_type": F.nullif(F.regexp_extract(response, _TYPE, 1), F.lit(""))}
    for f in SALVAGED:
        out[f] = F.nullif(F.regexp_extract(response, _field(f), 1), F.lit(""))
    return out


ANSWER_FIELDS = [name for fields in FIELDS.values() for name, _, _ in fields] + ["age"]
_PREDICTION = "struct<value:string,confidence:double>"


def _flat(key, got: dict | None) -> dict:
    row = {"key": key, "record_type": None if got is None else str(got.get("record_type")), "confidence": 0.0}
    found = []
    for f in ANSWER_FIELDS:
        x = (got or {}).get(f)
        if isinstance(x, dict):
            row[f] = {"value": str(x.get("value", "Unknown")), "confidence": float(x.get("confidence") or 0.0)}
            if "confidence" in x:
                found.append(row[f]["confidence"])
        else:
            row[f] = None
    row["confidence"] = sum(found) / len(found) if found else 0.0
    return row


def parse_answers(df: DataFrame, key: str, response: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Answers as ``key, record_type``, the fields, ``average`` and ``needs_review``; those that can't be read fall out.

    ``extra`` columns go with their rows.
    """
    extra = extra or {}
    p = pa.struct([("value", pa.string()), ("confidence", pa.float64())])
    arrow = pa.schema([("key", pa.int64()), ("record_type", pa.string()), ("confidence", pa.float64()), *[(f, p) for f in ANSWER_FIELDS]])

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(response).alias("response"), *[c.alias(n) for n, c in extra.items()])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = list(extra)

    def run(batches):
        for batch in batches:
            got = [salvage(r) for r in batch.column("response").to_pylist()]
            kept = [k for k, x in enumerate(got) if x is not None]
            keys = batch.column("key").to_pylist()
            out = pa.RecordBatch.from_pylist([_flat(keys[k], got[k]) for k in kept], schema=arrow)
            more = [batch.column(n).take(pa.array(kept, pa.int64())) for n in names]
            yield pa.RecordBatch.from_arrays([*out.columns, *more], names=[*out.schema.names, *names])

    schema = "key long, record_type string, confidence double, " + ", ".join(f"{f} {_PREDICTION}" for f in ANSWER_FIELDS)
    out = rows.mapInArrow(run, schema + "".join(f", {n} {kinds[n]}" for n in names))
    return out.withColumnRenamed("key", key).withColumnRenamed("confidence", "average").withColumn("needs_review", F.col("average") < 0.5)


def ask(df: DataFrame, key: str, text: str, provider: str | None = None, tries: int = 1) -> DataFrame:
    """``key, response, provider, source_length`` of the rows given; a provider that fails gives empty answers.

    An unknown provider is replaced as :func:`provider_for` says.  Each task
    stops asking a provider that has failed ``tries`` times in a row, so one that
    isn't there doesn't hold every row up.  Filter the rows by the gate first: a
    Python function runs on every row that reaches it.
    """
    name, function = provider_for(provider)

    def run(batches):
        failed = 0
        for batch in batches:
            answers = []
            for p in batch.column("prompt").to_pylist():
                answer = ""
                if failed < tries:
                    try:
                        answer, failed = function(p) or "", 0
                    except Exception:  # noqa: BLE001  an answer that doesn't come counts as empty
                        failed += 1
                answers.append(answer)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(answers, pa.string()), batch.column("source_length")], names=["key", "response", "source_length"]
            )

    rows = df.select(F.col(key).cast("long").alias("key"), prompt(F.col(text)).alias("prompt"), F.length(text).alias("source_length"))
    out = rows.mapInArrow(run, "key long, response string, source_length int").withColumnRenamed("key", key)
    return out.withColumn("provider", F.lit(name))


def extract_with_model(df: DataFrame, key: str, text: str, provider: str | None = None, model: str = "llama3.1:8b") -> DataFrame:
    """Records that a model reads from texts, with how they were made.

    ``_extraction`` has ``method`` (``llm``), ``model``, ``provider`` and
    ``source_length``.  Rows without a readable answer fall out; they keep the
    rules' record (:func:`vestry.operators.records.prefer_answers`).
    """
    asked = ask(df, key, text, provider)
    meta = F.struct(F.lit("llm").alias("method"), F.lit(model).alias("model"), F.col("provider"), F.col("source_length"))
    answers = parse_answers(asked, key, "response", extra={"_extraction": meta})
    return answers
