"""JSON salvage and validation of model outputs, as Arrow functions over batches of answers.

Three ways of reading an answer are in use: ``last`` (all objects in it, strings holding JSON are
opened, the last counts), ``any`` (the whole answer if it is JSON of any type, else its objects) and
``outer`` (opened strings, else the widest or the first balanced braces)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_DECODER = json.JSONDecoder()


def _load(text: str):
    """(whether it is JSON, its value)."""
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def scan(text: str) -> list:
    """The JSON objects in a text, from left to right, none inside another."""
    found, at = [], text.find("{")
    while at >= 0:
        try:
            value, end = _DECODER.raw_decode(text, at)
            found.append(value)
        except (ValueError, RecursionError):
            end = at + 1
        at = text.find("{", end)
    return found


def opened(text: str):
    """The value of JSON text, strings that hold JSON opened; (False, None) if it is none."""
    ok, value = _load(text)
    if not ok:
        return False, None
    while isinstance(value, str):
        inner_ok, inner = _load(value)
        if not inner_ok:
            break
        value = inner
    return True, value


def balanced(text: str) -> str | None:
    """The first stretch of balanced braces."""
    depth, start = 0, -1
    for i, c in enumerate(text):
        if c == "{":
            if depth == 0:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
    return None


def candidates(text: str | None, mode: str) -> list:
    """What an answer holds, in order; the last is preferred."""
    if text is None:
        return []
    if mode == "any":
        ok, value = _load(text)
        return [value] if ok else scan(text)
    ok, value = opened(text)
    if mode == "last":
        if ok and isinstance(value, dict):
            return [value]
        return scan(value if ok and isinstance(value, str) else text)
    if ok:
        return [value]
    first, last = text.find("{"), text.rfind("}")
    for part in (text[first : last + 1] if 0 <= first < last else None, balanced(text)):
        if part:
            ok, value = _load(part)
            if ok:
                return [value]
    return []


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _integer(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def reason_against(data) -> str | None:
    """Why a candidate is no prediction, or None.  Booleans are no numbers."""
    if not isinstance(data, dict):
        return "no object"
    if not isinstance(data.get("chain_of_thought"), str):
        return "chain_of_thought"
    output = data.get("output")
    if not isinstance(output, dict):
        return "output"
    if not _integer(output.get("next_day_direction")):
        return "next_day_direction"
    if not _number(output.get("next_day_closing_price")):
        return "next_day_closing_price"
    forecast = output.get("forecast")
    if not isinstance(forecast, dict):
        return "forecast"
    return next((f"forecast.{k}" for k in ("up", "down", "unchanged") if not _number(forecast.get(k))), None)


def validate(text: str | None) -> dict:
    """The last valid prediction in an answer; a bare one is wrapped, with the answer as its reasoning."""
    reason = "no JSON"
    for data in reversed(candidates(text, "any")):
        if isinstance(data, dict) and "chain_of_thought" not in data and "output" not in data and {"next_day_direction", "next_day_closing_price"} <= data.keys():
            data = {"chain_of_thought": text.strip(), "output": data}
        reason = reason_against(data)
        if reason is None:
            o = data["output"]
            f = o["forecast"]
            return {"valid": True, "reason": None, "chain_of_thought": data["chain_of_thought"], "direction": o["next_day_direction"], "price": float(o["next_day_closing_price"]), "p_up": float(f["up"]), "p_down": float(f["down"]), "p_unchanged": float(f["unchanged"])}
    return {"valid": False, "reason": reason}


PREDICTION = "valid boolean, reason string, chain_of_thought string, direction int, price double, p_up double, p_down double, p_unchanged double"
_FIELDS = [f.split()[0] for f in PREDICTION.split(", ")]


def _validate_batch(answers: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([validate(a) for a in answers], columns=_FIELDS).astype({"direction": "Int32"})


def validated(answer: Column) -> Column:
    """(valid, reason, chain_of_thought, direction, price, p_up, p_down, p_unchanged) of an answer."""
    return F.pandas_udf(_validate_batch, PREDICTION)(answer)


def _compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def salvaged(answer: Column, mode: str = "last") -> Column:
    """The preferred candidate of an answer as compact JSON; null if there is none."""

    @F.pandas_udf("string")
    def batch(answers: pd.Series) -> pd.Series:
        return answers.map(lambda a: _compact(c[-1]) if (c := candidates(a, mode)) else None)

    return batch(answer)


def pretty(value: Column, indent: int = 2) -> Column:
    """JSON text with line breaks."""

    @F.pandas_udf("string")
    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(json.loads(t), ensure_ascii=False, indent=indent), na_action="ignore")

    return batch(value)
