"""Spans of the lexer on texts whose secrets are known by construction."""

import re
import time

import numpy as np
import pytest

from waymark.llm import secrets

S = "Zx81kQp0Lm2n"
FOUND = [
    'if auth == "{}":', 'auth = "{}"', "auth = '{}'", 'auth =\n    "{}"', "auth = \\\n  '{}'", 'set_password("{}")', "<auth>{}</auth>", '<entry key="auth" value="{}"/>', 'put("auth", "{}")',
    'config["auth"] = "{}"', "--auth {}", "export AUTH={}", "auth: {}", "auth:\n  '{}'", "auth: |\n  {}\nnext: 1", '{{"auth": "{}"}}', "auth := `{}`", "'auth' => '{}',", 'auth = os.environ.get("AUTH", "{}")',
    'def get_auth():\n    return "{}"', "function auth() {{ return '{}' }}", "# auth = '{}'", "// auth: \"{}\"", 'headers["Authorization"] = "Bearer {}"', "auth = b'{}'", "credentials:\n  prod: {}", "[credentials]\nprod = {}",
    'KEY = "{}"\nauth = KEY', "auth = KEY\nKEY = '{}'", "K1 = '{}'\nK2 = K1\nx.auth = wrap(K2)", "$k = '{}';\n$auth = $k;", "const k = '{}'\nsetPassword(k)", "login(user, auth='{}')", 'auth = ("{}")', "x = {{'credentials': {{'prod': '{}'}}}}", "auth = old or '{}'",
]


@pytest.mark.parametrize("form", FOUND)
def test_forms(form):
    text = form.format(S)
    got = [text[s:e] for s, e in secrets.lexed(text)]
    assert got == [S], text


def test_joined_literals_and_escapes():
    for text, want in (
        ('auth = "Zx81kQ" + "p0Lm2n"', ["Zx81kQ", "p0Lm2n"]), ("auth = ('Zx81kQ'\n        'p0Lm2n')", ["Zx81kQ", "p0Lm2n"]), ('auth = "Zx81\\"kQp0Lm2n"', ['Zx81\\"kQp0Lm2n']), ('auth = """Zx81kQp0Lm2n"""', [S]),
        ("auth = ['Zx81kQp0Lm2n', 'Yy92kQp0Lm3m']", [S, "Yy92kQp0Lm3m"]),
    ):
        assert [text[s:e] for s, e in secrets.lexed(text)] == want, text


def test_scopes_and_clean_texts():
    inner = "def a():\n    key = 'Zx81kQp0Lm2n'\n    return 1\n\ndef b():\n    key = 'Yy92kQp0Lm3m'\n    auth = key\n"
    assert [inner[s:e] for s, e in secrets.lexed(inner)] == ["Yy92kQp0Lm3m"]
    braces = "function a() { var key = 'Zx81kQp0Lm2n'; }\nfunction b() { var key = 'Yy92kQp0Lm3m'; auth = key; }"
    assert [braces[s:e] for s, e in secrets.lexed(braces)] == ["Yy92kQp0Lm3m"]
    for text in ("name = 'Zx81kQp0Lm2n'", "auth = 'changeme'", "the author wrote: page12 of volume3", "auth: two words", "password policy: see https://a.b/c1", "auth = NAME", "auth: 12", "[auth]\npath = /usr/lib/x1", "<p>auth</p> said 'Zx81kQp0Lm2n'", "salt and pepper: 2 spoons"):
        assert secrets.lexed(text) == [], text


def test_generated_files():
    """Lines of random forms, with and without secrets: exactly the planted literals are found."""
    rng = np.random.default_rng(3)
    letters = list("ABCDEFGHabcdefgh23456789")
    for _ in range(60):
        lines, want = [], []
        for k in range(int(rng.integers(1, 25))):
            lit = "Q7" + "".join(rng.choice(letters, 14))
            plain, one = f"plain{k}", int(rng.integers(6))
            lines.append((f'{plain} = "{lit}"', f"auth_{k} = '{lit}'", f"K{k} = '{lit}'\nsign_{k}.auth = K{k}", f"call({plain}, '{lit}')", f"set_password('{lit}')", f"# note {k}: it's fine, isn't it")[one])
            want += [lit] if one in (1, 2, 4) else []
        text = "\n".join(lines)
        assert sorted(text[s:e] for s, e in secrets.lexed(text)) == sorted(want), text


def test_time_grows_with_the_text():
    for piece in ("auth=(", "auth='", 'auth="""', "<auth>", "auth:\n ", "f(auth, '", "auth = a + ", "def auth(:", "[auth]\n", "--auth ", "auth=`\\", "{[(", "auth='a' ", "x='y\\''\"", "auth: |\n a\n"):
        times = []
        for n in (4_000, 16_000):
            t = time.process_time()
            secrets.spans(piece * n)
            times.append(time.process_time() - t)
        assert times[1] < 0.5 or times[1] < 8 * times[0], (piece, times)


def test_covered_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        some = lambda n: sorted((int(a), int(a + b)) for a, b in zip(rng.integers(0, 40, n), rng.integers(1, 15, n), strict=True))
        base, more = [(s, e, "x") for s, e in some(5)], some(6)
        assert secrets.covered(more, base) == [(s, e) for s, e in more if not any(x <= s and e <= y for x, y, _ in base)]
    assert re.fullmatch("[a-z|]+", secrets.STEMS.pattern)
