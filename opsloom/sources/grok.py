"""Grok: named building blocks for regular expressions, and line packs for whole log families.

`%{NAME}` stands for a block, `%{NAME:field}` also captures it. A pattern is
expanded to one regular expression in which only fields are groups, so one
replacement per line takes all fields out. Packs are tried on each file's first
lines, and the one that fits most of them reads the whole file.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nesting of blocks, lines of a file that choose its pack, and the share of them that must fit.
DEPTH, PROBE, SHARE = 20, 120, 0.6
#: Lines of a file that are numbered together.
BLOCK = 100_000

# Building blocks.
BLOCKS = {
    "USERNAME": r"[a-zA-Z0-9._-]+", "USER": r"%{USERNAME}", "EMAILLOCALPART": r"[a-zA-Z][a-zA-Z0-9_.+-=:]+", "EMAILADDRESS": r"%{EMAILLOCALPART}@%{HOSTNAME}",
    "INT": r"(?:[+-]?(?:[0-9]+))", "BASE10NUM": r"(?<![0-9.+-])(?:[+-]?(?:(?:[0-9]+(?:\.[0-9]+)?)|(?:\.[0-9]+)))", "NUMBER": r"(?:%{BASE10NUM})", "BASE16NUM": r"(?<![0-9A-Fa-f])(?:[+-]?(?:0x)?(?:[0-9A-Fa-f]+))",
    "POSINT": r"\b(?:[1-9][0-9]*)\b", "NONNEGINT": r"\b(?:[0-9]+)\b", "WORD": r"\b\w+\b", "NOTSPACE": r"\S+", "SPACE": r"\s*", "DATA": r".*?", "GREEDYDATA": r".*",
    "QUOTEDSTRING": r"(?:\"(?:\\.|[^\\\"])*\"|'(?:\\.|[^\\'])*'|`(?:\\.|[^\\`])*`)", "QS": r"%{QUOTEDSTRING}", "UUID": r"[A-Fa-f0-9]{8}-(?:[A-Fa-f0-9]{4}-){3}[A-Fa-f0-9]{12}",
    "MAC": r"(?:%{CISCOMAC}|%{WINDOWSMAC}|%{COMMONMAC})", "CISCOMAC": r"(?:[A-Fa-f0-9]{4}\.){2}[A-Fa-f0-9]{4}", "WINDOWSMAC": r"(?:[A-Fa-f0-9]{2}-){5}[A-Fa-f0-9]{2}", "COMMONMAC": r"(?:[A-Fa-f0-9]{2}:){5}[A-Fa-f0-9]{2}",
    "IPV6": r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)",
    "IPV4": r"(?<![0-9])(?:(?:[0-1]?[0-9]{1,2}|2[0-4][0-9]|25[0-5])[.](?:[0-1]?[0-9]{1,2}|2[0-4][0-9]|25[0-5])[.](?:[0-1]?[0-9]{1,2}|2[0-4][0-9]|25[0-5])[.](?:[0-1]?[0-9]{1,2}|2[0-4][0-9]|25[0-5]))(?![0-9])",
    "IP": r"(?:%{IPV6}|%{IPV4})", "HOSTNAME": r"\b(?:[0-9A-Za-z][0-9A-Za-z-]{0,62})(?:\.(?:[0-9A-Za-z][0-9A-Za-z-]{0,62}))*(?:\.?|\b)", "IPORHOST": r"(?:%{IP}|%{HOSTNAME})", "HOSTPORT": r"%{IPORHOST}:%{POSINT}",
    "PATH": r"(?:%{UNIXPATH}|%{WINPATH})", "UNIXPATH": r"(?:/[\w_%!$@:.,+~-]*)+", "WINPATH": r"(?:[A-Za-z]:|\\)(?:\\[^\\?*]*)+", "TTY": r"(?:/dev/(?:pts|tty(?:[pq])?)(?:\w+)?/?(?:[0-9]+))",
    "URIPROTO": r"[A-Za-z](?:[A-Za-z0-9+\-.]+)+", "URIHOST": r"%{IPORHOST}(?::%{POSINT:port})?", "URIPATH": r"(?:/[A-Za-z0-9$.+!*'(){},~:;=@#%&_\-]*)+", "URIPARAM": r"\?[A-Za-z0-9$.+!*'|(){},~@#%&/=:;_?\-\[\]<>]*",
    "URIPATHPARAM": r"%{URIPATH}(?:%{URIPARAM})?", "URI": r"%{URIPROTO}://(?:%{USER}(?::[^@]*)?@)?(?:%{URIHOST})?(?:%{URIPATHPARAM})?",
    "MONTH": r"\b(?:[Jj]an(?:uary|uar)?|[Ff]eb(?:ruary|ruar)?|[Mm](?:a|ä)?r(?:ch|z)?|[Aa]pr(?:il)?|[Mm]a(?:y|i)?|[Jj]un(?:e|i)?|[Jj]ul(?:y|i)?|[Aa]ug(?:ust)?|[Ss]ep(?:tember)?|[Oo](?:c|k)?t(?:ober)?|[Nn]ov(?:ember)?|[Dd]e(?:c|z)(?:ember)?)\b",
    "MONTHNUM": r"(?:0?[1-9]|1[0-2])", "MONTHNUM2": r"(?:0[1-9]|1[0-2])", "MONTHDAY": r"(?:(?:0[1-9])|(?:[12][0-9])|(?:3[01])|[1-9])", "DAY": r"(?:Mon(?:day)?|Tue(?:sday)?|Wed(?:nesday)?|Thu(?:rsday)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?)",
    "YEAR": r"(?:\d\d){1,2}", "HOUR": r"(?:2[0123]|[01]?[0-9])", "MINUTE": r"(?:[0-5][0-9])", "SECOND": r"(?:(?:[0-5]?[0-9]|60)(?:[:.,][0-9]+)?)", "TIME": r"%{HOUR}:%{MINUTE}(?::%{SECOND})(?![0-9])",
    "DATE_US": r"%{MONTHNUM}[/-]%{MONTHDAY}[/-]%{YEAR}", "DATE_EU": r"%{MONTHDAY}[./-]%{MONTHNUM}[./-]%{YEAR}", "ISO8601_TIMEZONE": r"(?:Z|[+-]%{HOUR}(?::?%{MINUTE}))", "ISO8601_SECOND": r"(?:%{SECOND}|60)",
    "TIMESTAMP_ISO8601": r"%{YEAR}-%{MONTHNUM}-%{MONTHDAY}[T ]%{HOUR}:?%{MINUTE}(?::?%{SECOND})?%{ISO8601_TIMEZONE}?", "DATE": r"%{DATE_US}|%{DATE_EU}", "DATESTAMP": r"%{DATE}[- ]%{TIME}", "TZ": r"(?:[APMCE][SD]T|UTC|GMT|TRT)",
    "HTTPDERROR_DATE": r"%{DAY} %{MONTH} %{MONTHDAY} %{TIME} %{YEAR}", "SYSLOGTIMESTAMP": r"%{MONTH} +%{MONTHDAY} %{TIME}", "PROG": r"[\x21-\x5a\x5c\x5e-\x7e]+", "SYSLOGPROG": r"%{PROG:program}(?:\[%{POSINT:pid}\])?",
    "SYSLOGHOST": r"%{IPORHOST}", "SYSLOGFACILITY": r"<%{NONNEGINT:facility}.%{NONNEGINT:priority}>", "HTTPDATE": r"%{MONTHDAY}/%{MONTH}/%{YEAR}:%{TIME} %{INT}",
    "LOGLEVEL": r"(?:[Aa]lert|ALERT|[Tt]race|TRACE|[Dd]ebug|DEBUG|[Nn]otice|NOTICE|[Ii]nfo?(?:rmation)?|INFO?(?:RMATION)?|[Ww]arn?(?:ing)?|WARN?(?:ING)?|[Ee]rr?(?:or)?|ERR?(?:OR)?|[Cc]rit?(?:ical)?|CRIT?(?:ICAL)?|[Ff]atal|FATAL|[Ss]evere|SEVERE|EMERG(?:ENCY)?|[Ee]merg(?:ency)?)",
    "JAVACLASS": r"(?:[a-zA-Z$_][a-zA-Z$_0-9]*\.)*[a-zA-Z$_][a-zA-Z$_0-9]*", "JAVAMETHOD": r"(?:(?:<(?:cl)?init>)|[a-zA-Z$_][a-zA-Z$_0-9]*)", "CATALINA_DATESTAMP": r"(?:%{MONTH} %{MONTHDAY}, %{YEAR} %{HOUR}:%{MINUTE}:%{SECOND} (?:AM|PM))",
    "TOMCAT_DATESTAMP": r"%{YEAR}-%{MONTHNUM}-%{MONTHDAY} %{HOUR}:%{MINUTE}:%{SECOND}(?:,%{INT})? %{ISO8601_TIMEZONE}?", "SQUID_STATUS": r"(?:TCP|UDP|NONE)_[A-Z_]+", "NAGIOSTIME": r"\[%{NUMBER:nagios_epoch}\]",
    "QUANTITY": r"%{NUMBER}\s?(?:ms|us|ns|s|sec|m|min|h|%|[KMGT]i?B|[kmgt]b|B)", "MTE": r"\\{0,2}[\w.-]+\\[^\s]+",
}
_APACHE = r'^%{IPORHOST:clientip} %{USER:ident} %{USER:auth} \[%{HTTPDATE:timestamp}\] "(?:%{WORD:verb} %{NOTSPACE:request}(?: HTTP/%{NUMBER:httpversion})?|%{DATA:rawrequest})" %{NUMBER:response} (?:%{NUMBER:bytes}|-)'
_SYS = "^%{SYSLOGTIMESTAMP:timestamp} %{SYSLOGHOST:host} "


class Pack(NamedTuple):
    name: str
    pattern: str
    family: str
    roles: dict  # role -> field


def _roles(text: str) -> dict:
    return dict(x.split("=") for x in text.split())


# Line packs, with the field that plays each role.
PACKS = [
    Pack("SYSLOGLINE", r"^%{SYSLOGTIMESTAMP:timestamp} (?:%{SYSLOGFACILITY} )?%{SYSLOGHOST:host} %{SYSLOGPROG}: %{GREEDYDATA:message}$", "syslog", _roles("timestamp=timestamp host=host service=program message=message")),
    Pack("COMMONAPACHELOG", _APACHE, "http", _roles("timestamp=timestamp message=request status=response")),
    Pack("COMBINEDAPACHELOG", _APACHE + " %{QS:referrer} %{QS:agent}", "http", _roles("timestamp=timestamp message=request status=response")),
    Pack("HTTPD_ERRORLOG", r"^\[%{HTTPDERROR_DATE:timestamp}\] \[(?:%{WORD:module}:)?%{LOGLEVEL:loglevel}\] \[pid %{POSINT:pid}(?::tid %{NUMBER:tid})?\](?: \[client %{IPORHOST:clientip}(?::%{POSINT:clientport})?\])? %{GREEDYDATA:message}$", "apache", _roles("timestamp=timestamp severity=loglevel message=message")),
    Pack("TOMCAT_CATALINA", r"^%{CATALINA_DATESTAMP:timestamp} %{JAVACLASS:class} %{JAVAMETHOD:method}\s*$", "tomcat", _roles("timestamp=timestamp service=class")),
    Pack("TOMCAT_JULI", r"^%{TOMCAT_DATESTAMP:timestamp} %{LOGLEVEL:level} \[%{DATA:thread}\] %{JAVACLASS:class}\.%{JAVAMETHOD:method} %{GREEDYDATA:message}$", "tomcat", _roles("timestamp=timestamp severity=level service=class message=message")),
    Pack("SQUID_ACCESS", r"^%{NUMBER:timestamp}\s+%{NUMBER:duration}\s+%{IP:clientip}\s+%{SQUID_STATUS:squid_status}/%{NUMBER:response}\s+%{NUMBER:bytes}\s+%{WORD:verb}\s+%{NOTSPACE:request}\s+%{NOTSPACE:user}\s+%{NOTSPACE:hierarchy}\s+%{NOTSPACE:content_type}", "squid", _roles("timestamp=timestamp message=request status=response")),
    Pack("BIND9_QUERY", r"^%{MONTHDAY:day}-%{MONTH:month}-%{YEAR:year} %{TIME:time}(?:\.%{INT:ms})? (?:queries: )?(?:%{LOGLEVEL:level}: )?client(?: @0x[0-9a-f]+)? %{IP:clientip}#%{POSINT:clientport}(?: \(%{DATA:qname}\))?: query: %{NOTSPACE:query} %{WORD:qclass} %{WORD:qtype} %{GREEDYDATA:flags}$", "bind", _roles("severity=level message=query")),
    Pack("IPTABLES", r"^(?:%{SYSLOGTIMESTAMP:timestamp} %{SYSLOGHOST:host} kernel: )?(?:\[\s*%{NUMBER:uptime}\] )?\[?%{DATA:prefix}\]?\s*IN=%{DATA:in_if} OUT=%{DATA:out_if} (?:MAC=%{DATA:mac} )?SRC=%{IP:src} DST=%{IP:dst} %{GREEDYDATA:rest}$", "iptables", _roles("timestamp=timestamp host=host message=prefix")),
    Pack("NAGIOS_LOG", r"^%{NAGIOSTIME} (?:%{WORD:nagios_type}: )?%{GREEDYDATA:message}$", "nagios", _roles("timestamp=nagios_epoch message=message")),
    Pack("SSHD_AUTH", _SYS + r"sshd\[%{POSINT:pid}\]: (?:%{WORD:result}) (?:password|publickey) for (?:invalid user )?%{USERNAME:user} from %{IP:src} port %{POSINT:port}(?: ssh2)?", "sshd", _roles("timestamp=timestamp host=host message=result")),
    Pack("SUDO", _SYS + r"sudo(?:\[%{POSINT:pid}\])?:\s+%{DATA:user} : (?:%{DATA:error} ; )?TTY=%{TTY:tty} ; PWD=%{DATA:pwd} ; USER=%{USERNAME:runas} ; COMMAND=%{GREEDYDATA:command}$", "sudo", _roles("timestamp=timestamp host=host message=command")),
    Pack("CRON", _SYS + r"(?:CRON|crond)\[%{POSINT:pid}\]: \(%{USERNAME:user}\) CMD \(%{GREEDYDATA:command}\)$", "cron", _roles("timestamp=timestamp host=host message=command")),
    Pack("DHCPD", _SYS + r"dhcpd(?:\[%{POSINT:pid}\])?: DHCP(?:%{WORD:dhcp_op}) (?:on|for|from) %{IP:ip}(?: \(%{DATA:client}\))? (?:from|to|via) %{GREEDYDATA:rest}$", "dhcpd", _roles("timestamp=timestamp host=host message=dhcp_op")),
    Pack("VMWARE_ESXI", r"^%{TIMESTAMP_ISO8601:timestamp} (?:%{LOGLEVEL:level}\s+)?%{NOTSPACE:program}\[%{DATA:context}\](?: \[%{DATA:opid}\])?:? %{GREEDYDATA:message}$", "esxi", _roles("timestamp=timestamp severity=level service=program message=message")),
    Pack("RABBITMQ", r"^%{TIMESTAMP_ISO8601:timestamp} \[%{LOGLEVEL:level}\] <%{DATA:pid}> %{GREEDYDATA:message}$", "rabbitmq", _roles("timestamp=timestamp severity=level message=message")),
    Pack("DOCKER_DAEMON", r'^time="%{TIMESTAMP_ISO8601:timestamp}" level=%{LOGLEVEL:level} msg="%{DATA:message}"(?: %{GREEDYDATA:rest})?$', "dockerd", _roles("timestamp=timestamp severity=level message=message")),
    Pack("EXIM_MAIN", r"^%{YEAR}-%{MONTHNUM}-%{MONTHDAY} %{TIME} (?:\[%{POSINT:pid}\] )?(?:%{NOTSPACE:msgid} )?(?:<=|=>|->|\*\*|==) %{GREEDYDATA:message}$", "exim", _roles("message=message")),
    Pack("DOVECOT", _SYS + r"dovecot: %{WORD:proc}(?:\(%{DATA:user}\))?(?:<%{DATA:session}>)?: %{GREEDYDATA:message}$", "dovecot", _roles("timestamp=timestamp host=host message=message")),
    Pack("F5_BIGIP", _SYS + r"%{WORD:level} %{NOTSPACE:program}\[%{POSINT:pid}\]: %{NOTSPACE:msgid}: %{GREEDYDATA:message}$", "bigip", _roles("timestamp=timestamp host=host severity=level service=program message=message")),
    Pack("JUNIPER_JUNOS", _SYS + r"%{NOTSPACE:program}(?:\[%{POSINT:pid}\])?: %{WORD:msgid}: %{GREEDYDATA:message}$", "junos", _roles("timestamp=timestamp host=host service=program message=message")),
    Pack("CHECKPOINT_LEA", _SYS + r"(?:CP-GW|CheckPoint) - (?:%{DATA:product}) - (?:%{GREEDYDATA:message})$", "checkpoint", _roles("timestamp=timestamp host=host message=message")),
    Pack("ZEEK_CONN", r"^%{NUMBER:timestamp}\t%{NOTSPACE:uid}\t%{IP:src}\t%{POSINT:src_port}\t%{IP:dst}\t%{POSINT:dst_port}\t%{WORD:proto}\t%{GREEDYDATA:rest}$", "zeek", _roles("timestamp=timestamp message=proto")),
    Pack("WINDOWS_TEXT_EVENT", r"^%{TIMESTAMP_ISO8601:timestamp}\s+(?:%{LOGLEVEL:level})\s+%{POSINT:event_id}\s+%{DATA:source}\s+%{GREEDYDATA:message}$", "windows", _roles("timestamp=timestamp severity=level service=source message=message")),
    Pack("RUBY_LOGGER", r"^%{WORD:level_letter}, \[%{TIMESTAMP_ISO8601:timestamp} #%{POSINT:pid}\] +%{LOGLEVEL:level} -- (?:%{DATA:progname})?: %{GREEDYDATA:message}$", "ruby", _roles("timestamp=timestamp severity=level service=progname message=message")),
    Pack("NODE_WINSTON", r"^%{TIMESTAMP_ISO8601:timestamp} \[%{LOGLEVEL:level}\](?: \[%{DATA:label}\])?:? %{GREEDYDATA:message}$", "node", _roles("timestamp=timestamp severity=level service=label message=message")),
    Pack("SAP_CCMS_ALERT", r"^%{TIMESTAMP_ISO8601:timestamp}\s+%{LOGLEVEL:level}\s+%{MTE:mte}\s+%{GREEDYDATA:message}$", "sap-ccms", _roles("timestamp=timestamp severity=level service=mte message=message")),
]
ROLES = ("timestamp", "severity", "host", "service", "message")
#: A line that goes on with the one above.
GOES_ON = r"^(?:\s|at |Caused by|\.\.\. \d+ more|Traceback)"
_REFERENCE = re.compile(r"%\{(\w+)(?::(\w+))?(?::\w+)?\}")
#: Characters of an expanded pattern of a user, at most, and a repeated group that itself repeats.
LONGEST, RISKY = 4000, re.compile(r"\([^()]*[+*][^()]*\)\s*[*+]|\)\s*\+\s*[*+]")


class Compiled(NamedTuple):
    regex: str
    fields: tuple


def expand(pattern: str, extra: dict | None = None) -> Compiled:
    """The regular expression of a pattern, and its fields in the order of their groups.

    Unknown blocks, blocks that contain themselves and nesting beyond DEPTH are errors.
    """
    known, fields = {**BLOCKS, **(extra or {})}, []

    def work(text: str, above: tuple) -> str:
        def one(m: re.Match) -> str:
            name, field = m[1], m[2]
            if name not in known:
                raise ValueError(f"unknown block {name}")
            if name in above or len(above) >= DEPTH:
                raise ValueError(f"block {name} " + ("contains itself" if name in above else "nests too deep"))
            if field:
                fields.append(field)
            return ("(" if field else "(?:") + work(known[name], (*above, name)) + ")"

        return _REFERENCE.sub(one, text)

    return Compiled(work(pattern, ()), tuple(fields))


def checked(pattern: str, extra: dict | None = None) -> Compiled:
    """`expand` for a user's pattern: one that is too long or repeats repetitions is refused."""
    c = expand(pattern, extra)
    if len(c.regex) > LONGEST or RISKY.search(c.regex):
        raise ValueError("pattern is too long or repeats a repetition")
    return c


def captured(line: Column, c: Compiled) -> Column:
    """Fields of a line as a map, without those that are empty; null where the pattern doesn't fit. The first of equal names that has a value counts."""
    if not c.fields:
        return F.when(line.rlike(c.regex), F.create_map().cast("map<string,string>"))
    whole = c.regex if c.regex.startswith("^") else "^.*?(?:" + c.regex + ")"
    whole = whole if whole.endswith("$") else whole + ".*$"
    values = F.split(F.regexp_replace(line, whole, "\x01".join(f"${i + 1}" for i in range(len(c.fields)))), "\x01", -1)
    entries = F.filter(F.arrays_zip(F.array(*map(F.lit, c.fields)).alias("key"), values.alias("value")), lambda e: e["value"] != "")
    if len(set(c.fields)) < len(c.fields):
        entries = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, 1, i), lambda x: x["key"] == e["key"]))
    return F.when(line.rlike(c.regex), F.map_from_entries(entries))


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def detect(lines: DataFrame, packs: list[Pack] = PACKS) -> DataFrame:
    """(file, pack, share): the pack that fits most of the file's first PROBE lines that aren't blank, if it fits SHARE of them; the first of equals."""
    probe = lines.where(F.col("line_no") <= PROBE).where(_bare(F.col("line")) != "")
    hits = probe.groupBy("file").agg(F.count("*").alias("n"), *[F.count_if(F.col("line").rlike(expand(p.pattern).regex)).alias(f"p{i}") for i, p in enumerate(packs)])
    best = F.array_max(F.array(*[F.struct(F.col(f"p{i}").alias("hits"), F.lit(-i).alias("k"), F.lit(p.name).alias("pack")) for i, p in enumerate(packs)]))
    return hits.select("file", best.alias("b"), "n").where(F.col("b.hits") >= SHARE * F.col("n")).select("file", "b.pack", F.round(F.col("b.hits") / F.col("n"), 2).alias("share"))


def last_so_far(rows: DataFrame, key: str, order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """The last value that isn't null at or before each row of a key, in blocks of `order` numbers, so a key of many rows is many tasks' work."""
    rows = rows.withColumn("_v", value).withColumn("_block", F.floor(F.col(order) / block))
    ends = rows.groupBy(key, "_block").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_end"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(key, "_block", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    own = F.last("_v", ignorenulls=True).over(Window.partitionBy(key, "_block").orderBy(order))
    return rows.join(ends, [key, "_block"]).withColumn(name, F.coalesce(own, "_carried")).drop("_v", "_block", "_carried")


def parse(lines: DataFrame, packs: list[Pack] = PACKS) -> DataFrame:
    """Records of files that a pack reads: file, line_no, pack, lines, timestamp, severity, host, service, message, attributes.

    `lines` has file, line_no (from 1) and line. Blank lines are passed over; a
    line that doesn't fit and goes on with the one above is part of its message,
    any other is a message alone. A status stands for a severity: 5xx ERROR, 4xx
    WARN, else INFO. Files that no pack fits give nothing.
    """
    chosen = lines.where(_bare(F.col("line")) != "").join(detect(lines, packs), "file")
    fields, roles, family = F.lit(None).cast("map<string,string>"), F.lit(None).cast("map<string,string>"), F.lit(None).cast("string")
    for p in packs:
        mine = F.col("pack") == p.name
        fields = F.when(mine, captured(F.col("line"), expand(p.pattern))).otherwise(fields)
        roles = F.when(mine, F.create_map(*[F.lit(x) for kv in p.roles.items() for x in kv])).otherwise(roles)
        family = F.when(mine, p.family).otherwise(family)
    rows = chosen.select("file", "line_no", "line", "pack", F.inline(F.array(F.struct(fields.alias("f"), roles.alias("r"), family.alias("family")))))
    # The first line of a file has none above.
    begins = F.col("f").isNotNull() | ~F.col("line").rlike(GOES_ON)
    rows = last_so_far(rows, "file", "line_no", F.when(begins, F.col("line_no")), "event").withColumn("event", F.coalesce("event", "line_no"))
    head = F.col("line_no") == F.col("event")
    more = F.array_sort(F.collect_list(F.when(~head, F.struct("line_no", _bare(F.col("line")).alias("t")))))
    e = rows.groupBy("file", "event").agg(F.max_by("pack", head).alias("pack"), F.max_by("f", head).alias("f"), F.max_by("r", head).alias("r"), F.max_by("family", head).alias("family"), F.max_by("line", head).alias("line"), F.count("*").alias("lines"), more.alias("more"))
    role = lambda name: F.col("f")[F.col("r")[name]]
    status = role("status")
    severity = F.coalesce(role("severity"), F.when(status.startswith("5"), "ERROR").when(status.startswith("4"), "WARN").when(status.isNotNull(), "INFO"))
    message = F.coalesce(role("message"), F.col("f")["message"], _bare(F.col("line")))
    others = F.map_filter(F.coalesce("f", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_values("r"), k))
    return e.select(
        "file", F.col("event").alias("line_no"), "pack", "lines", role("timestamp").alias("timestamp"), severity.alias("severity"), role("host").alias("host"), F.coalesce(role("service"), "family").alias("service"),
        F.concat_ws("\n", F.array(message), F.transform("more", lambda x: x["t"])).alias("message"), others.alias("attributes"),
    )
