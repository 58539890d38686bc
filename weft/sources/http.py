"""Calls over HTTP as a source: requests are built as Columns, sent in batches by a client that is handed in."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMEOUT = 30
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
Client = Callable[[str, str, dict, bytes], tuple[int, bytes]]


def urllib_client(method: str, url: str, headers: dict, body: bytes) -> tuple[int, bytes]:
    """The standard library's client. A status outside 2xx is an answer, not an error."""
    request = urllib.request.Request(url, data=body or None, headers=headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def request(settings: dict, url: Column | None = None, headers: Column | None = None, payload: Column | None = None, base_url: str = "") -> Column:
    """Struct (method, url, headers, body). The url comes from the connection, the settings or the input; a payload that
    is base64 is decoded, other text is sent as it is. Header modes: config, input or merge (the input's stand)."""
    method = (settings.get("method") or "GET").upper()
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    fixed = settings.get("url") or ""
    absolute = base_url.rstrip("/") + "/" + fixed.lstrip("/") if base_url and fixed and "://" not in fixed else fixed or base_url
    target = F.coalesce(F.lit(absolute or None).cast("string"), url if url is not None else F.lit(None).cast("string"))
    own = dict(settings.get("headers") or {})
    if settings.get("bearer_token"):
        own["Authorization"] = f"Bearer {settings['bearer_token']}"
    config = F.create_map(*[F.lit(x) for kv in own.items() for x in kv]).cast("map<string,string>") if own else F.create_map().cast("map<string,string>")
    given = F.coalesce(headers, F.create_map().cast("map<string,string>")) if headers is not None else F.create_map().cast("map<string,string>")
    mode = settings.get("headers_source") or "merge"
    merged = F.map_concat(F.map_filter(config, lambda k, _: ~F.map_contains_key(given, k)), given)
    chosen = {"config": config, "input": given, "merge": merged}[mode]
    text = payload if payload is not None else F.lit(None).cast("string")
    is_base64 = text.rlike(r"^[A-Za-z0-9+/]+={0,2}$") & (F.length(text) % 4 == 0)
    body = F.when(is_base64, F.try_to_binary(text, F.lit("base64"))).otherwise(text.cast("binary"))
    return F.struct(F.lit(method).alias("method"), target.alias("url"), chosen.alias("headers"), F.coalesce(body, F.lit(b"")).alias("body"))


def call(df: DataFrame, request_column: str, client: Client = urllib_client) -> DataFrame:
    """Adds ``status``, ``body`` (base64) and ``http_error``. Failed calls are values; Spark may call again after a lost task."""
    names = df.columns
    text = df.withColumn("__q", F.to_json(F.struct(F.col(f"{request_column}.method").alias("m"), F.col(f"{request_column}.url").alias("u"), F.col(f"{request_column}.headers").alias("h"), F.base64(f"{request_column}.body").alias("b"))))

    def one(q: str) -> tuple[int | None, str | None, str | None]:
        x = json.loads(q)
        if not x.get("u"):
            return None, None, "no url"
        try:
            status, body = client(x["m"], x["u"], x.get("h") or {}, base64.b64decode(x.get("b") or ""))
            return status, base64.b64encode(body).decode(), None
        except Exception as e:  # noqa: BLE001  any failure of a call is data here
            return None, None, f"{type(e).__name__}: {e}"

    @F.pandas_udf("status int, body string, http_error string")
    def send(qs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(q) for q in qs], columns=["status", "body", "http_error"]).astype({"status": "Int32"})

    return text.withColumn("__a", send.asNondeterministic()("__q")).select(*names, "__a.*")
