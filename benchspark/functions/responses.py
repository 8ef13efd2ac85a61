"""Reading stored model responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchspark.functions.labels import (
    clean_label,
    filter_phrase,
    first_two_sentences,
    is_generic,
    sanitize,
    strict_noun_phrase,
)
from benchspark.functions.text import WS, col, let, lower_strip, strip, text

# Domains of the answer fields.
CONFIDENCES = ["LOW", "MEDIUM", "HIGH"]
VERDICTS = ["CORRECT", "INCORRECT", "UNCLEAR"]
SCENES = ["COMMON_AREA", "OFFICE", "STORAGE_AREA", "KITCHEN", "LAB", "SHOP", "OTHER", "UNCLEAR"]
FITS = ["YES", "NO", "UNCLEAR"]
PRESENCES = ["PRESENT", "NOT_PRESENT", "UNCLEAR"]


def _none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _within(c: Column, domain: Sequence[str], default: str | None) -> Column:
    up = F.upper(strip(text(c)))
    return F.when(up.isin(*domain), up).otherwise(F.lit(default))


# --- JSON (D1, D2) -------------------------------------------------------------------------------------------------

def strip_fence(c) -> Column:
    s = strip(text(c))
    inner = F.regexp_replace(F.regexp_replace(s, rf"^(?i)```(?:json)?{WS}*", ""), rf"{WS}*```$", "")
    return F.when(s.startswith("```"), strip(inner)).otherwise(s)


def _json_object(s: Column) -> Column:
    """The text as a VARIANT if it is a JSON object."""
    parsed = F.try_parse_json(s)
    return F.when(s.startswith("{") & s.endswith("}"), parsed)


def extract_json(c) -> Column:
    """JSON object of a response as VARIANT: the whole text, else the widest braces in it, else NULL."""

    def find(s):
        return F.coalesce(_json_object(s), _json_object(F.regexp_extract(s, r"(?s)\{.*\}", 0)))

    return let(strip_fence(c), find)


def json_field(obj: Column, key: str) -> Column:
    return F.try_variant_get(obj, f"$.{key}", "string")


def partial_field(c, keys: Sequence[str], value: str = r'[^"\n\r}]*') -> Column:
    """First quoted value of the keys in broken JSON, whether or not its closing quote is there."""
    found = [strip(F.regexp_extract(col(c), rf'(?i)"{k}"{WS}*:{WS}*"({value})', 1)) for k in keys]
    return F.coalesce(*[_none(f) for f in found])


def keyed_field(c, key: str, value: str = r"[^\n]+") -> Column:
    """Value of a ``KEY: value`` line."""
    return _none(strip(F.regexp_extract(col(c), rf"(?i){key}{WS}*:{WS}*({value})", 1)))


def parse_health(c) -> Column:
    """STRUCT(parse_ok, partial, status) of a JSON response."""

    def judge(s):
        ok = F.try_parse_json(s).isNotNull()
        opens = F.length(s) - F.length(F.replace(s, F.lit("{"), F.lit("")))
        closes = F.length(s) - F.length(F.replace(s, F.lit("}"), F.lit("")))
        cut = (opens > closes) | s.endswith(":") | s.endswith(",") | s.endswith('"')
        return F.struct(
            ((s != "") & ok).alias("parse_ok"),
            ((s != "") & ~ok & cut).alias("partial"),
            F.when(s == "", "empty").when(ok, "ok").otherwise("invalid").alias("status"),
        )

    return let(strip_fence(c), judge)


# --- labelled answers (D3, D4) -------------------------------------------------------------------------------------

def _final_label(found: Column, raw: Column) -> Column:
    """Found label, else a noun phrase of the whole text; NULL if it is no usable label."""
    first = F.coalesce(_none(found), strict_noun_phrase(raw, 4), clean_label(raw, 4))
    return let(let(first, lambda f: sanitize(filter_phrase(f))), lambda s: F.when(~is_generic(s), s))


def _sentences(c: Column) -> Column:
    return _none(first_two_sentences(c))


def parse_teacher(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Teacher answer as columns, from JSON, from broken JSON or from ``KEY: value`` lines (D3)."""
    txt = strip(text(raw))
    d = df.withColumn("__t", txt).withColumn("__o", extract_json(txt))
    t, o = F.col("__t"), F.col("__o")
    is_json = o.isNotNull()
    cut_label = partial_field(t, ["final_label", "label"])
    cut_verdict = partial_field(t, ["qwen_verdict", "verdict"])
    cut_conf = partial_field(t, ["confidence"])
    recovered = cut_label.isNotNull() | cut_verdict.isNotNull() | cut_conf.isNotNull()

    def either(json_keys, line):
        from_json = F.coalesce(*[_none(json_field(o, k)) for k in json_keys])
        return F.when(is_json, from_json).otherwise(line)

    found = either(["final_label", "label"], F.coalesce(keyed_field(t, "FINAL_LABEL"), cut_label))
    verdict = either(["qwen_verdict", "verdict"], F.coalesce(keyed_field(t, "QWEN_VERDICT", "[A-Z_]+"), cut_verdict))
    conf = either(["confidence"], F.coalesce(keyed_field(t, "CONFIDENCE", "[A-Z]+"), cut_conf))
    scene = either(["scene_setting"], keyed_field(t, "SCENE_SETTING", "[A-Z_]+"))
    context = either(["target_local_context"], keyed_field(t, "TARGET_LOCAL_CONTEXT"))
    why = either(["rationale"], keyed_field(t, "RATIONALE"))
    out = d.withColumn("final_label", _final_label(found, t)).withColumn("__rec", recovered)
    has_label = F.col("final_label").isNotNull()
    return out.select(
        *df.columns,
        "final_label",
        _within(verdict, VERDICTS, "UNCLEAR").alias("qwen_verdict"),
        _within(conf, CONFIDENCES, "LOW").alias("confidence"),
        _within(scene, SCENES, "UNCLEAR").alias("scene_setting"),
        _sentences(context).alias("target_local_context"),
        _sentences(why).alias("rationale"),
        ((is_json | (t != "")) & has_label).alias("parse_ok"),
        F.when(is_json, "ok").when(t == "", "empty").when(F.col("__rec"), "partial_recovered").otherwise("invalid").alias("parse_status"),
        (~is_json & (t != "") & F.col("__rec")).alias("parse_partial"),
        F.when(is_json & has_label, "json_object")
        .when(is_json, "json_missing_label")
        .when(t == "", "empty_text")
        .when(F.col("__rec"), "partial_json_fields")
        .otherwise("non_json_fallback")
        .alias("parse_reason"),
    )


KEYED_KINDS = ("arbiter", "guardrail", "refine")


def parse_keyed(df: DataFrame, kind: str, raw: str = "raw") -> DataFrame:
    """Arbiter, guardrail or refine answer of ``KEY: value`` lines as columns."""
    if kind not in KEYED_KINDS:
        raise ValueError(f"kind must be one of {KEYED_KINDS}")
    d = df.withColumn("__t", strip(text(raw)))
    t = F.col("__t")
    columns = [
        _final_label(keyed_field(t, "FINAL_LABEL"), t).alias("final_label"),
        _within(keyed_field(t, "CONFIDENCE", "[A-Z]+"), CONFIDENCES, "LOW").alias("confidence"),
        _sentences(keyed_field(t, "RATIONALE")).alias("rationale"),
    ]
    if kind != "refine":
        columns.append(F.coalesce(F.upper(keyed_field(t, "DECISION", "[A-Z_]+")), F.lit("UNSURE")).alias("decision"))
    if kind == "guardrail":
        columns += [
            _within(keyed_field(t, "SCENE_SETTING", "[A-Z_]+"), SCENES, "UNCLEAR").alias("scene_setting"),
            _sentences(keyed_field(t, "TARGET_LOCAL_CONTEXT")).alias("target_local_context"),
            _within(keyed_field(t, "SCENE_FIT_CURRENT", "[A-Z]+"), FITS, "UNCLEAR").alias("scene_fit_current"),
            _within(keyed_field(t, "SCENE_FIT_PROPOSED", "[A-Z]+"), FITS, "UNCLEAR").alias("scene_fit_proposed"),
        ]
    return d.select(*df.columns, *columns)


# --- verifier answers (D5) -----------------------------------------------------------------------------------------

def parse_verifier(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Visibility-verifier answer as columns."""
    t0 = strip(text(raw))
    d = df.withColumn("__t", t0).withColumn(
        "__o", let(t0, lambda s: F.coalesce(_json_object(s), _json_object(F.regexp_extract(s, r"(?s)\{.*\}", 0))))
    )
    t, o = F.col("__t"), F.col("__o")
    is_json = o.isNotNull()
    quoted = {
        "prediction": "[A-Z]+", "presence": "[A-Z_]+", "person_presence": "[A-Z_]+", "confidence": "[A-Z]+",
    }
    cut = {k: partial_field(t, [k], v) for k, v in quoted.items()}
    recovered = F.coalesce(*cut.values()).isNotNull()

    def value(k):
        return F.when(is_json, json_field(o, k)).otherwise(F.coalesce(keyed_field(t, k.upper(), quoted[k]), cut[k]))

    out = d.select(
        *df.columns,
        "__t",
        is_json.alias("__json"),
        recovered.alias("__rec"),
        _within(value("prediction"), ["YES", "NO"], None).alias("prediction"),
        _within(value("presence"), PRESENCES, None).alias("presence"),
        _within(value("person_presence"), PRESENCES, None).alias("person_presence"),
        _within(value("confidence"), CONFIDENCES, "LOW").alias("confidence"),
        _none(strip(F.when(is_json, json_field(o, "rationale")).otherwise(keyed_field(t, "RATIONALE")))).alias("rationale"),
    )
    full = F.col("prediction").isNotNull() & F.col("presence").isNotNull() & F.col("person_presence").isNotNull()
    js, t, rec = F.col("__json"), F.col("__t"), F.col("__rec")
    return out.select(
        *[c for c in out.columns if not c.startswith("__")],
        ((t != "") & full).alias("parse_ok"),
        F.when(js, "ok").when(t == "", "empty").when(rec, "partial_recovered").otherwise("invalid").alias("parse_status"),
        (~js & (t != "") & rec).alias("parse_partial"),
        F.when(js & full, "json_object")
        .when(js, "json_missing_required_fields")
        .when(t == "", "empty_text")
        .when(rec, "partial_json_fields")
        .otherwise("non_json_fallback")
        .alias("parse_reason"),
    )


# --- short answers (D6-D8) -----------------------------------------------------------------------------------------

def parse_same_object(c) -> Column:
    """STRUCT(same, canonical) of a "yes ... canonical: x" answer."""
    yes = lower_strip(text(c)).startswith("yes")
    canon = filter_phrase(strict_noun_phrase(keyed_field(text(c), "canonical"), 4))
    return F.struct(yes.alias("same"), F.when(yes, canon).alias("canonical"))


def choose_by_letter(c, choices: dict[str, str]) -> Column:
    """Value of the first letter; the first choice for anything else."""
    table = F.create_map(*[F.lit(v) for pair in choices.items() for v in pair])
    letter = F.upper(F.substring(strip(text(c)), 1, 1))
    return F.coalesce(F.try_element_at(table, letter), F.lit(next(iter(choices.values()))))


def parse_verdict(c, strict: bool = False) -> Column:
    """``correct`` or ``wrong``. By default "incorrect" counts as correct, as it holds the word; ``strict`` asks for the
    word itself (D8)."""
    low = lower_strip(text(c))
    right = low.rlike(r"\bcorrect\b") & ~low.rlike(r"\bnot\b") if strict else low.contains("correct")
    return F.when(right & ~low.contains("wrong"), "correct").otherwise("wrong")


# --- payloads (D9, D10) --------------------------------------------------------------------------------------------

_USAGE = (
    "usage struct<prompt_tokens:string,input_tokens:string,completion_tokens:string,output_tokens:string,total_tokens:string,"
    "cached_input_tokens:string,prompt_tokens_details:struct<cached_tokens:string>>,"
    "usageMetadata struct<promptTokenCount:string,candidatesTokenCount:string,totalTokenCount:string,cachedContentTokenCount:string>"
)


def extract_usage(payload) -> Column:
    """STRUCT of input, output, cached and total tokens from either usage shape."""

    def filled(prompt, completion, total, cached, rest):
        inp, out = F.coalesce(prompt, F.lit(0)), F.coalesce(completion, F.lit(0))
        both = F.coalesce(F.nullif(total, F.lit(0)), inp + out)
        # a response may count tokens beyond the prompt without saying how many it wrote
        wrote = F.when((out <= 0) & (both > inp), both - inp).otherwise(out) if rest else out
        return F.struct(
            inp.alias("input_tokens"), wrote.alias("output_tokens"),
            F.coalesce(cached, F.lit(0)).alias("cached_input_tokens"), both.alias("total_tokens"),
        )

    def number(holder: Column, *names: str) -> Column:
        return F.coalesce(*[holder.getField(n).try_cast("bigint") for n in names])

    def read(doc):
        u, m = doc.getField("usage"), doc.getField("usageMetadata")
        a = filled(
            number(u, "prompt_tokens", "input_tokens"), number(u, "completion_tokens", "output_tokens"), number(u, "total_tokens"),
            F.coalesce(number(u.getField("prompt_tokens_details"), "cached_tokens"), number(u, "cached_input_tokens")), rest=False,
        )
        b = filled(
            number(m, "promptTokenCount"), number(m, "candidatesTokenCount"), number(m, "totalTokenCount"),
            number(m, "cachedContentTokenCount"), rest=True,
        )
        return F.when(m.isNotNull(), b).otherwise(a)

    return let(F.from_json(col(payload), _USAGE), read)


def extract_text(payload) -> Column:
    """STRUCT(text, finish_reason) from chat-completion, plain-text, output-list or candidates payloads."""
    p = col(payload)
    part = "array<struct<text:string>>"

    def joined(parts: Column) -> Column:
        texts = F.filter(F.transform(parts, lambda x: x["text"]), lambda x: x != "")
        return _none(strip(F.array_join(texts, "\n")))

    content = F.get_json_object(p, "$.choices[0].message.content")
    chunks = F.when(content.startswith("["), F.from_json(content, part))
    plain = F.when(chunks.isNull(), _none(strip(content)))
    output = F.from_json(F.get_json_object(p, "$.output"), f"array<struct<content:{part}>>")
    cands = F.from_json(
        F.get_json_object(p, "$.candidates"), f"array<struct<content:struct<parts:{part}>,finishReason:string>>"
    )
    by_cand = F.filter(
        F.transform(cands, lambda c: joined(c["content"]["parts"])), lambda t: t.isNotNull()
    )
    answer = F.coalesce(
        plain,
        joined(chunks),
        _none(strip(F.get_json_object(p, "$.choices[0].text"))),
        joined(F.flatten(F.transform(output, lambda i: F.coalesce(i["content"], F.array().cast(part))))),
        F.get(by_cand, F.lit(0)),
        F.lit(""),
    )
    reasons = F.filter(F.transform(cands, lambda c: c["finishReason"]), lambda r: r != "")
    finish = F.coalesce(
        F.get_json_object(p, "$.choices[0].finish_reason"), F.get(reasons, F.lit(0)), F.lit("")
    )
    return F.struct(answer.alias("text"), finish.alias("finish_reason"))


# --- errors (D11, D12) ---------------------------------------------------------------------------------------------

def classify_error(c) -> Column:
    """quota, auth, not_found, transient or unknown."""
    up = F.upper(text(c))
    return (
        F.when(up.rlike("RESOURCE_EXHAUSTED|INSUFFICIENT|QUOTA|BILLING|FREE TRIAL"), "quota")
        .when(up.rlike("PERMISSION_DENIED|API ERROR 40[13]"), "auth")
        .when(up.rlike("API ERROR 404|NOT_FOUND"), "not_found")
        .when(up.rlike("READ TIMED OUT|API REQUEST ERROR|API ERROR (408|409|429|500|502|503|504)"), "transient")
        .otherwise("unknown")
    )


def is_hard_error(c) -> Column:
    return classify_error(c).isin("quota", "auth", "not_found")


def fatal_reason(c) -> Column:
    """Reason for which a run stops, or the empty text."""
    e = lower_strip(text(c))
    return (
        F.when(e.contains("insufficient_quota"), "insufficient_quota")
        .when(e.contains("resource_exhausted") & e.contains("quota"), "resource_exhausted_quota")
        .when(e.contains("quota") & e.rlike("exceed|limit|billing"), "quota_or_billing_limit")
        .when(e.rlike("invalid api key|incorrect api key"), "invalid_api_key")
        .when(e.rlike("unauthorized|authentication|permission denied"), "auth_or_permission_error")
        .when(e.rlike("package is required|no module named"), "missing_api_package")
        .otherwise("")
    )
