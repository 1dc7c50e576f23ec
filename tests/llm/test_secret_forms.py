"""Forms of assignments in source and configuration: recall, no false spans, and work that grows with the text."""

from __future__ import annotations

import time

import pytest

from boxwood.llm import secret_scans as S

LITERAL = "Zk83hfLq02ndYw7"

FORMS = [
    'config["db_pwd"] = "{}"',
    "os.environ['DB_AUTH'] = '{}'",
    "define('DB_PWD', '{}')",
    'setDbPwd("{}")',
    '<add key="dbPwd" value="{}"/>',
    '<dbPwd>{}</dbPwd>',
    '--db-pwd={}',
    'run --db-pwd {} now',
    'Authorization: Bearer {}',
    'pg://u:{}@h',
    'db_pwds = ["{}", "b"]',
    'db_pwds = [\n  "b",\n  "{}"\n]',
    'db_pwd, user = "{}", "bob"',
    'user, db_pwd = "bob", "{}"',
    'K = "{}"\ndb_pwd = f"{K}"',
    'db_pwd = x or "{}"',
    'db_pwd = get("a") or "{}"',
    'os.getenv("DB_PWD", "{}")',
    'A = "Zk83hfLq"\nB = "02ndYw7"\ndb_pwd = A + B',
    'db_pwd += "{}"',
    'ENV DB_PWD {}',
    'variable "db_pwd" {\n  default = "{}"\n}',
    'val dbPwd by lazy { "{}" }',
    "ALTER USER bob PASSWORD '{}'",
    "CREATE USER bob IDENTIFIED BY '{}'",
    'db_pwd = b"{}"',
    'db_pwd = r"{}"',
    'wchar_t *dbPwd = L"{}"',
    'const dbPwd string = "{}"',
    '#define DB_PWD "{}"',
    '{"db_pwd", "{}"}',
    '- name: DB_PWD\n  value: {}',
    '{"name": "DB_PWD", "value": "{}"}',
    'char db_pwd[] = "{}"',
    'char db_pwd[32] = "{}";',
    '{\\"db_pwd\\": \\"{}\\"}',
    "$c['a']['db_pwd'] = '{}';",
    'db_pwd := "{}"',
    'client.password("{}")',
    'db_pwd = ("Zk83hfLq"\n "02ndYw7")',
    'db_pwd ??= "{}"',
    'db_pwd ||= "{}"',
]

CLEAN = [
    'the "token" is lost, "or so" he said',
    'config["name"] = "Zk83hfLq02ndYw7"',
    'call("user", "Zk83hfLq02ndYw7")',
    'setUser("Zk83hfLq02ndYw7")',
    '<user>Zk83hfLq02ndYw7</user>',
    '--user=Zk83hfLq02ndYw7',
    'http://a.b/c@d:e',
    'ENV HOST Zk83hfLq02ndYw7',
    "it's the key to 'success'",
    'getSecret("prod-db-name")',
    'for key, value in rows: x = "Zk83hfLq02ndYw7"',
    'pwd, user = load()',
    'user, host = "Zk83hfLq02ndYw7", "x"\npwd = load(1)',
    'f(pwd, b="Zk83hfLq02ndYw7", c)',
    '<a key="dbPwd"/>\nuser = "Zk83hfLq02ndYw7"',
]


@pytest.mark.parametrize("form", FORMS)
def test_form_is_paired(form):
    clean = S.redact(form.replace("{}", LITERAL))
    assert not any(x in clean for x in (LITERAL, LITERAL[:8], LITERAL[8:]))


@pytest.mark.parametrize("text", CLEAN)
def test_other_names_keep_their_literals(text):
    assert S.value_spans(text) == []


@pytest.mark.parametrize("unit", ["a:(", "a:[b, ", "x:function(a){return b({", '\\"', '"\\"', "a:> ", "a:<b ", "a, ", "--token ", "<key ", "://a:", '("key", ', 'a=["x",', "pwd = a + a\n", "b['key']="])
def test_work_grows_with_the_text(unit):
    """Quadratic work took from ten seconds to hours at this length."""
    begin = time.process_time()
    S.all_spans("k=1 " + unit * (200_000 // len(unit)))
    assert time.process_time() - begin < 6


def test_spans_are_the_literals():
    for text in ('db_pwd = b"{}"', "db_pwd = r\'{}\'", 'db_pwd = """{}"""', '{\\"db_pwd\\": \\"{}\\"}', "<dbPwd>{}</dbPwd>", "pg://u:{}@h"):
        at = text.index("{}")
        assert S.value_spans(text.replace("{}", LITERAL)) == [(at, at + len(LITERAL), "value")]
