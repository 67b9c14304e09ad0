"""Synthetic logs in the three line formats, skewed like real ones; rows follow from (seed, row number) alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import TracewellError

# Compression ratios are compared with published ones on lines of this distribution, so the pools
# and ranges that values are drawn from are those of the published measurement.
NETWORKS = ((4134, "CN"), (4837, "CN"), (14061, "US"), (16509, "US"), (15169, "US"), (13335, "US"), (8075, "US"), (24940, "DE"), (16276, "FR"), (12389, "RU"), (8359, "RU"), (9009, "GB"), (45102, "CN"), (37963, "CN"), (3462, "TW"))
FLOW_PORTS = (443, 80, 53, 22, 3389, 8080, 25, 123)
FLOW_PROTOCOLS = ("tcp", "tcp", "tcp", "udp")
FLOW_EVENTS = ("flow", "flow", "flow", "scan", "rejected")
SERVICES = (("ssh", 22), ("rdp", 3389), ("telnet", 23), ("smtp", 25), ("smb", 445), ("mssql", 1433))
LOGIN_EVENTS = ("login.failed", "login.failed", "login.failed", "login.failed", "scan", "login.success")
USERS = ("root", "admin", "user", "test", "oracle", "ubuntu", "guest", "postgres", "git", "administrator")
PASSWORDS = ("123456", "password", "admin", "root", "12345678", "qwerty", "1qaz2wsx", "letmein", "P@ssw0rd")
METHODS = ("GET", "GET", "GET", "GET", "POST", "HEAD")
PATHS = ("/", "/index.html", "/login", "/wp-login.php", "/admin", "/api/v1/users", "/favicon.ico", "/static/app.js", "/.env", "/phpmyadmin")
STATUSES = (200, 200, 200, 304, 404, 403, 301, 500)
AGENTS = ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36", "Mozilla/5.0 (X11; Linux x86_64) Gecko/20100101 Firefox/115.0", "curl/7.88.1", "python-requests/2.31.0", "Googlebot/2.1")
START_SECONDS = 1_717_200_000  # 2024-06-01T00:00:00Z
STEP_NS = 1_100_000  # mean distance of two records
POOL = 400  # source addresses

SOURCES = ("generic-flow", "honeypot", "web-access")


def generate(spark: SparkSession, source: str, rows: int, seed: int = 1) -> DataFrame:
    """``value``: one line a row. Times rise with jitter, low pool entries are drawn far more often."""
    if source not in SOURCES:
        raise TracewellError(f"unknown source {source!r}; known: {', '.join(SOURCES)}")

    def unit(draw: str, of: Column | None = None) -> Column:
        return F.shiftrightunsigned(F.xxhash64(of if of is not None else F.col("id"), F.lit(draw), F.lit(seed)), 11) / F.lit(float(1 << 53))

    def below(draw: str, n: int, of: Column | None = None) -> Column:
        return F.floor(unit(draw, of) * n).cast("int")

    def skewed(draw: str, n: int) -> Column:
        return F.floor(unit(draw) * unit(draw) * n).cast("int")

    def pick(values: tuple, index: Column) -> Column:
        return F.element_at(F.array(*(F.lit(v) for v in values)), index + 1)

    host = skewed("host", POOL)
    source_ip = F.concat_ws(".", *(c.cast("string") for c in (45 + below("a", 180, host), below("b", 256, host), below("c", 256, host), 1 + below("d", 254, host))))
    ns = F.col("id") * STEP_NS + F.floor(unit("jitter") * (STEP_NS - 100_000)).cast("bigint") + 100_000
    at = F.timestamp_seconds(F.lit(START_SECONDS) + F.floor(ns / 1_000_000_000))
    stamp = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.concat(F.lit("."), F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0")), r"\.?0+$", ""), F.lit("Z"))
    network = skewed("asn", len(NETWORKS))
    asn, country = pick(tuple(a for a, _ in NETWORKS), network), pick(tuple(c for _, c in NETWORKS), network)
    text = lambda key, value: F.concat(F.lit(f',"{key}":"'), value, F.lit('"'))
    number = lambda key, value: F.concat(F.lit(f',"{key}":'), value.cast("string"))
    head = F.concat(F.lit('{"timestamp":"'), stamp, F.lit('"'), text("srcip", source_ip))
    ids = spark.range(rows)
    if source == "generic-flow":
        inner = F.concat_ws(".", F.lit("10"), *(c.cast("string") for c in (below("e", 256), below("f", 256), 1 + below("g", 254))))
        line = F.concat(head, text("dstip", inner), number("srcport", 1024 + below("sp", 64_000)), number("dstport", pick(FLOW_PORTS, skewed("dp", len(FLOW_PORTS)))), text("protocol", pick(FLOW_PROTOCOLS, below("pr", len(FLOW_PROTOCOLS)))), number("asn", asn), text("country", country), text("eventtype", pick(FLOW_EVENTS, skewed("ev", len(FLOW_EVENTS)))), number("bytes", 40 + below("by", 60_000)), number("packets", 1 + below("pk", 40)), F.lit("}"))
    elif source == "honeypot":
        service = skewed("svc", len(SERVICES))
        event = pick(LOGIN_EVENTS, skewed("ev", len(LOGIN_EVENTS)))
        login = F.when(event == "scan", "").otherwise(F.concat(text("username", pick(USERS, skewed("us", len(USERS)))), text("password", pick(PASSWORDS, skewed("pw", len(PASSWORDS))))))
        line = F.concat(head, number("srcport", 1024 + below("sp", 64_000)), number("dstport", pick(tuple(p for _, p in SERVICES), service)), text("protocol", pick(tuple(s for s, _ in SERVICES), service)), text("eventtype", event), number("asn", asn), text("country", country), login, F.lit("}"))
    else:
        clf = F.date_format(at, "dd/MMM/yyyy:HH:mm:ss")
        line = F.concat(source_ip, F.lit(" - - ["), clf, F.lit(' +0000] "'), pick(METHODS, below("m", len(METHODS))), F.lit(" "), pick(PATHS, skewed("pa", len(PATHS))), F.lit(' HTTP/1.1" '), pick(STATUSES, skewed("st", len(STATUSES))).cast("string"), F.lit(" "), below("by", 50_000).cast("string"), F.lit(' "-" "'), pick(AGENTS, skewed("ua", len(AGENTS))), F.lit('"'))
    return ids.select(line.alias("value"))
