"""External link checks (X1, X2): off by default, over distinct URLs, behind an address guard."""

from __future__ import annotations

import ipaddress
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: (ok, status or None, blocked)
Result = tuple[bool, int | None, bool]


def resolve(host: str) -> list[str]:
    return [x[4][0] for x in socket.getaddrinfo(host, None)]


def is_internal(address: str) -> bool:
    """Loopback, private, link-local, reserved and the like, mapped addresses included."""
    ip = ipaddress.ip_address(address.split("%")[0])
    ip = getattr(ip, "ipv4_mapped", None) or ip
    shared = ip.version == 4 and ip in ipaddress.ip_network("100.64.0.0/10")
    return shared or not ip.is_global or ip.is_multicast or ip.is_reserved or ip.is_unspecified


def allowed(url: str, lookup: Callable[[str], list[str]] = resolve, allow: tuple[str, ...] = (), deny: tuple[str, ...] = ()) -> bool:
    """Whether a URL may be asked: http(s), not denied, allowed if there is an allow list, and no internal address."""
    parts = urlsplit(url)
    host = (parts.hostname or "").lower()
    if parts.scheme not in ("http", "https") or not host:
        return False
    under = lambda names: any(host == n or host.endswith("." + n) for n in names)
    if under(deny) or allow and not under(allow):
        return False
    try:
        found = lookup(host)
    except OSError:
        return False
    return bool(found) and not any(map(is_internal, found))


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):  # every redirect is guarded by ask()
        return None


def fetch(url: str, method: str, timeout: float = 5.0) -> tuple[int, str | None]:
    """(status, redirect target)."""
    opener = urllib.request.build_opener(_NoRedirect)
    try:
        with opener.open(urllib.request.Request(url, method=method), timeout=timeout) as answer:
            return answer.status, None
    except urllib.error.HTTPError as answer:
        return answer.code, answer.headers.get("Location")


def ask(url: str, get: Callable[[str, str], tuple[int, str | None]] = fetch, guard: Callable[[str], bool] = allowed, redirects: int = 5) -> Result:
    """HEAD, then GET where HEAD is not offered; up to ``redirects`` redirects, each guarded."""
    status = None
    for _ in range(redirects + 1):
        if not guard(url):
            return False, status, True
        try:
            status, there = get(url, "HEAD")
            if status in (405, 501):
                status, there = get(url, "GET")
        except OSError:
            return False, None, False
        if 300 <= status < 400 and there:
            url = urljoin(url, there)
            continue
        return 200 <= status < 400, status, False
    return False, status, False


def check(refs: DataFrame, one: Callable[[str], Result] = ask, pause: float = 0.2) -> DataFrame:
    """(url, ok, status, blocked) of the distinct http links; hosts stay in one task and wait between requests."""
    urls = refs.where("health = 'external'").where(T.is_http(F.col("raw_target"))).select(F.col("raw_target").alias("url")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for batch in batches:
            rows = []
            for url in batch["url"]:
                host = urlsplit(url).hostname or ""
                time.sleep(max(0.0, last.get(host, 0.0) + pause - time.monotonic()))
                rows.append((url, *one(url)))
                last[host] = time.monotonic()
            yield pd.DataFrame(rows, columns=["url", "ok", "status", "blocked"]).astype({"status": "Int64"})

    host = F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1)
    return urls.repartition(8, host).mapInPandas(run, "url string, ok boolean, status long, blocked boolean")
