"""Parse jobs on good, bad and blank lines together."""

from pyspark.sql import functions as F

import pytest

from millrace.errors import split_errors
from millrace.sources import parse


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_delimited(spark):
    df = lines(
        spark, '1 fufu 3.14 {"x":1,"y":"2"} 2017-01-02T03:04:05Z', 'cc jj uu {"x":1,"y":"2"} 2017-01-02T03:04:05Z',
        "2 fufu 3.15 999 2017-01-02T03:04:05Z", '3 fufu 3.16 {"x":1,"y":["xx:12"]} 2017-01-02T03:04:05Z', "   ", "4 fufu 3.17  2017-01-02T03:04:05Z",
    )
    schema = [("a", "long"), ("b", "string"), ("c", "float"), ("d", "jsonmap"), ("e", "date")]
    good, bad = split_errors(parse.delimited(df, schema, " "))
    assert [r.a for r in good.orderBy("a").collect()] == [1, 3, 4]
    assert good.where("a = 1").first().d["x"] == "1"
    assert sorted(r.raw_line.split()[0] for r in bad.collect()) == ["2", "cc"]


def test_delimited_separator_inside(spark):
    df = parse.delimited(lines(spark, "1,a,b,c,9"), [("x", "long"), ("t", "string"), ("y", "long")], ",", contain_sep="t")
    assert df.select("x", "t", "y").first() == (1, "a,b,c", 9)


def test_json_lists_and_malformed(spark):
    df = parse.jsonl(lines(spark, '{"a":1}', '[{"a":2},{"a":3}]', "{oops"), "a long", labels={"a": 7, "env": "x"})
    good, bad = split_errors(df)
    assert sorted(r.a for r in good.collect()) == [1, 2, 3]
    assert bad.first().raw_line == "{oops"
    assert good.first().env == "x"


def test_grok_first_match_and_failed_cast(spark):
    df = parse.grok(lines(spark, "142 bot", "12:00 bot", "???"), ["^%{INT:num:long} %{WORD:client}$", "%{NUMBER:at:date} %{WORD:client}$"])
    rows = {r.value: r for r in df.collect()}
    assert (rows["142 bot"].num, rows["142 bot"].client) == (142, "bot")
    assert (rows["12:00 bot"].num, rows["12:00 bot"].at, rows["12:00 bot"].client) == (None, None, "bot")
    assert rows["???"]._errors


def test_access_log_bad_line_and_dash(spark):
    df = parse.access_log(lines(spark, '1.1.1.1 [x] "GET /" - 5', "can't work"), '$ip [$t] "$req" $n $m', {"n": "long", "m": "long"})
    good, bad = split_errors(df)
    r = good.first()
    assert (r.ip, r.req, r.n, r.m) == ("1.1.1.1", "GET /", 0, 5)
    assert bad.count() == 1


def test_key_value(spark):
    df = parse.key_value(lines(spark, 'ts=2018-01-02T03:04:05.123Z  CST   lvl=5 msg="error" isTest=true log_id=123456abc', " =50", "a", "lvl= "))
    good, bad = split_errors(df)
    f = {r.value: r.fields for r in good.collect()}
    assert f['ts=2018-01-02T03:04:05.123Z  CST   lvl=5 msg="error" isTest=true log_id=123456abc'] == {
        "ts": "2018-01-02T03:04:05.123Z  CST", "lvl": "5", "msg": "error", "isTest": "true", "log_id": "123456abc",
    }
    assert bad.count() == 2


def test_audit(spark):
    line = 'type=PATH msg=audit(1364481363.243:24287): item=0 name="/etc/ssh" dev=fd:00 dev=system_u'
    r = parse.audit(lines(spark, line)).first()
    assert r.fields["dev"] == "fd:00" and r.fields["dev_1"] == "system_u" and r.msg_id == "24287"
    r = parse.audit(lines(spark, "type=CWD msg='op=PAM:secret test1=\"a\" res=success' cwd=\"/home\"")).first()
    assert r.msg == {"op": "PAM:secret", "test1": "a", "res": "success"} and r.fields["cwd"] == "/home"


def test_syslog(spark):
    df = parse.syslog(lines(spark, "<34>1 2003-10-11T22:14:15.003Z mymachine.example.com su - ID47 - BOM'su root' failed", "<34>Oct 11 22:14:15 mymachine tag[9]: 'su root' failed",
                            '<165>1 2003-10-11T22:14:15.003Z h evntslog - ID47 [ex@32473 iut="3" eventID="1011"] m', "Test my syslog CRON[000]: (root) CMD"), year=2004)
    rows = {r.value[:9]: r for r in df.collect()}
    new, old, data, bad = rows["<34>1 200"], rows["<34>Oct 1"], rows["<165>1 20"], rows["Test my s"]
    assert (new.priority, new.facility, new.severity, new.app_name, new.proc_id) == (34, 4, 2, "su", None)
    assert (old.hostname, old.app_name, old.proc_id, old.timestamp.year) == ("mymachine", "tag", "9", 2004)
    assert data.structured_data == {"ex@32473": {"iut": "3", "eventID": "1011"}}
    assert bad._errors and bad.raw_line.startswith("Test")


def test_application_lines(spark):
    r = parse.redis_log(lines(spark, "[14204] 02 Apr 11:19:26.804 # You requested maxclients")).first()
    assert (r.pid, r.level) == (14204, "warning")
    r = parse.tode_log(lines(spark, "[00:00:07 413]INFO:vm:bbl_hb:55322:[BBLHbCtrl.cpp:1108]:  *** server: Shutdown.")).first()
    assert (r.level, r.host, r.server, r.pid, r.line, r.message) == ("INFO", "vm", "bbl_hb", "55322", "1108", "*** server: Shutdown.")
    r = parse.container_path(lines(spark, "/var/logs/containers/admin-220-jrhnr_zhujiali_admin-92.log"), "value").first()
    assert (r.pod, r.namespace, r.container_name, r.container_id) == ("admin-220-jrhnr", "zhujiali", "admin", "92")


def test_nothing_in_nothing_out(spark):
    empty = lines(spark).where(F.lit(False))
    assert parse.grok(empty, ["%{WORD:a}"]).count() == 0
    assert parse.empty(lines(spark, "x")).count() == 0


#: Lines of the formats' own documentation, and what they hold.
def test_grok_library(spark):
    nginx = '192.168.45.53 - - [05/Apr/2017:17:25:06 +0800] "POST /v2/repos/data HTTP/1.1" 200 497 2 "-" "Go 1.1 package http"'
    common = '127.0.0.1 user-identifier frank [10/Oct/2000:13:55:36 -0700] "GET /apache_pb.gif HTTP/1.0" 200 2326'
    r = parse.grok(lines(spark, nginx), ["%{NGINX_LOG}"]).first()
    assert (r.client_ip, r.verb, r.http_version, r.resp_code, r.resp_bytes, r.ts.isoformat()) == ("192.168.45.53", "POST", 1.1, "200", 497, "2017-04-05T09:25:06")
    assert parse.grok(lines(spark, nginx), ["%{NGINX_LOG}"], offset_hours=-3).first().ts.hour == 6
    r = parse.grok(lines(spark, common), ["^%{COMMONAPACHELOG}$"]).first()
    assert (r.clientip, r.ident, r.auth, r.request, r.response, r.bytes) == ("127.0.0.1", "user-identifier", "frank", "/apache_pb.gif", "200", "2326")
    for value, pattern in [
        ("2001:db8::1", "^%{IPV6:x}$"), ("00:1B:44:11:3A:B7", "^%{MAC:x}$"), ("/usr/lib/x.so", "^%{PATH:x}$"), ("http://u@h.org:80/a(b)?c=[d]", "^%{URI:x}$"),
        ("Mar 28 15:41:53", "^%{SYSLOGTIMESTAMP:x}$"), ("WARNING", "^%{LOGLEVEL:x}$"), ("'it\\'s'", "^%{QS:x}$"), ("2017-03-28T15:41:53+08:00", "^%{TIMESTAMP_ISO8601:x}$"),
    ]:
        got = parse.grok(lines(spark, value), [pattern]).first()
        assert got.x is not None and not got._errors, value
    for value, pattern in [("12:30", "^%{IPV6:x}$"), ("Janx", "^%{MONTH:x}$"), ("12:00", "^%{TIME:x}$"), ("/a?b", "^%{URIPATH:x}$")]:
        assert parse.grok(lines(spark, value), [pattern]).first()._errors, value


def test_grok_pattern_files(spark, tmp_path):
    (tmp_path / "own").write_text("# mine\nDURATION %{NUMBER}[nuµm]?s\n\nLINE %{DURATION:took} (a|[(]b[)]) %{WORD:w}\n", encoding="utf-8")
    rows = parse.grok(lines(spark, "1.25ms a x", "3s (b) y"), ["^%{LINE}$"], pattern_files=[str(tmp_path / "own")]).orderBy("w").collect()
    assert [(r.took, r.w) for r in rows] == [("1.25ms", "x"), ("3s", "y")]
    assert parse.without_captures(r"(?<n>a)(?:b)[(\])](c)\(") == r"(?:a)(?:b)[(\])](?:c)\("


def test_syslog_without_data(spark):
    df = parse.syslog(lines(spark, "<34>1 2003-10-11T22:14:15.003Z mymachine.example.com su - ID47- BOM'su root' failed for lonvick on /dev/pts/8",
                            "<34>Oct 11 22:14:15 mymachine very.large.syslog.message.tag: 'su root' failed", "83 <1>Feb 05 01:02:03 abc system[23]: Listening at 0.0.0.0:3001"), year=2018)
    a, b, c = sorted(df.collect(), key=lambda r: (r.priority, r.value))[1:] + sorted(df.collect(), key=lambda r: (r.priority, r.value))[:1]
    assert (a.app_name, a.proc_id, a.msg_id, a.message, a.structured_data) == ("su", None, "ID47-", "BOM'su root' failed for lonvick on /dev/pts/8", None)
    assert (b.facility, b.severity, b.app_name, b.message) == (4, 2, "very.large.syslog.message.tag", "'su root' failed")
    assert (c.proc_id, c.message, c.timestamp.isoformat()) == ("23", "Listening at 0.0.0.0:3001", "2018-02-05T01:02:03")
    assert not any(r._errors for r in (a, b, c))


def test_header_log_combined_heads(spark):
    rows = {r.value[:19]: r for r in parse.header_log(lines(
        spark, "2017/03/28 15:41:06 [Wm0AAPg-IUMW-68U][INFO] bdc.go:573: deleted: 67608",
        '2018/08/30 11:45:00.386289 [INFO][gRI0EyK7amyzjE8V]["github.com/teapots/request-logger/logger.go:75"] [REQ_END] 200 0.010k 183.637ms',
        "2018/08/17 10:49:29 [INFO][github.com/x/reader] seqfile.go:538: Runner[Name] ", "2016/10/20 18:20:30.642666 [ERROR] github.com/x/queue/disk.go:241: readOne() error", "hello",
    )).collect()}
    pick = lambda r: (r.reqid, r.level, r.module, r.file, r.log)
    assert pick(rows["2017/03/28 15:41:06"]) == ("Wm0AAPg-IUMW-68U", "INFO", None, "bdc.go:573", "deleted: 67608")
    assert pick(rows["2018/08/30 11:45:00"]) == ("gRI0EyK7amyzjE8V", "INFO", '"github.com/teapots/request-logger/logger.go:75"', None, "[REQ_END] 200 0.010k 183.637ms")
    assert pick(rows["2018/08/17 10:49:29"]) == (None, "INFO", "github.com/x/reader", "seqfile.go:538", "Runner[Name] ")
    assert pick(rows["2016/10/20 18:20:30"]) == (None, "ERROR", None, "github.com/x/queue/disk.go:241", "readOne() error")
    assert rows["hello"]._errors and rows["2018/08/30 11:45:00"].time.microsecond == 386289


def test_key_value_options(spark):
    r = parse.key_value(lines(spark, 'lvl=5 ok=true d=1.5 msg="a k=v b" lvl=7 at=2017-03-28 t=x  y  z'), typed={"lvl": "long", "ok": "bool", "d": "float", "at": "date", "none": "long"}).first()
    assert r.fields == {"lvl": "7", "ok": "true", "d": "1.5", "msg": "a k=v b", "at": "2017-03-28", "t": "x  y  z"}
    assert (r.lvl, r.ok, r.d, r.at.day, r.none) == (7, True, 1.5, 28, None)
    assert parse.key_value(lines(spark, "a:1 b: two words"), splitter=":").first().fields == {"a": "1", "b": "two words"}
    assert parse.key_value(lines(spark, "lvl=5"), typed={"lvl": "long"}, keep_string=True).first().lvl == "5"


def test_access_log_format_of_a_configuration(spark):
    config = """
    http {
      # log_format main '$no';
      log_format other '$a $b';
      log_format main escape=json '$ip [$t] '
                      '"$req" $n'
                      ' $m';
      access_log /x.log main;
    }"""
    assert parse.format_of(config, "main") == '$ip [$t] "$req" $n $m'
    assert parse.format_of(config, "other") == "$a $b"
    with pytest.raises(ValueError, match="no log_format mai"):
        parse.format_of(config, "mai")
    df = parse.access_log(lines(spark, '1.1.1.1 [x] "GET /" - 5'), "main", {"n": "long", "m": "long"}, config=config)
    assert tuple(df.select("ip", "req", "n", "m").first()) == ("1.1.1.1", "GET /", 0, 5)
