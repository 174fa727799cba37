"""The lexer of the secret scan, by hand-written cases."""

import hashlib

import pytest

from rankloom.llm import secrets

S = "Zx9fPq7Lm31vRt8K"

CASES = [
    (f'os.environ["TOKEN"] = "{S}"', [S]),
    (f'<add key="DbPassword" value="{S}"/>', [S]),
    (f'{{"name": "api_key", "value": "{S}"}}', [S]),
    (f"""password = "it's{S}" """, [f"it's{S}"]),
    (f'password = "a\\"b{S}"', [f'a\\"b{S}']),
    (f'k = "{S}"\nsecret = k.strip()', [S]),
    (f'k = "{S}"\nj = k\nclient_secret = j', [S]),
    (f'secret = "{S}1" + "{S}2"', [f"{S}1", f"{S}2"]),
    (f'db_secret = os.getenv("X") or "{S}"', [S]),
    ('db_secret = os.getenv("SOME_LONG_NAME_1")', []),
    ("db_secret = config.secret_token_value9", []),
    (f'password: str = "{S}"', [S]),
    (f'password: Optional[str] = "{S}"', [S]),
    (f'connect(host="h", password="{S}")', [S]),
    (f"export DB_PASSWORD={S}\n", [S]),
    (f"[db]\npasswd = {S} ; comment", [S]),
    (f"tls:\n  private_key: |\n    {S}AA\n    {S}BB\n  other: x", [f"{S}AA", f"{S}BB"]),
    (f'SECRET = """{S}"""', [S]),
    (f"secret = '''{S}''' + \"{S}9\"", [S, f"{S}9"]),
    (f'# password = "{S}"', [S]),
    (f'secret := "{S}"; x := 1', [S]),
    (f'"secret" => "{S}"', [S]),
    (f'if password == "{S}":', []),
    (f'title = "{S}"', []),
    ('password = ""\nsecret = "changeme"', []),
    (f'auth_token = b"{S}"', [S]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_lexer(text, want):
    assert [text[s:e] for _, s, e in sorted(secrets.lexed_spans(text), key=lambda x: x[1])] == want


@pytest.mark.parametrize("text", ["a=" * 200_000, "a=b(" * 100_000, 'a="' * 100_000, "a: |\n" * 20_000, "k='''" * 50_000, "x=y+" * 100_000, 'key="a" ' * 50_000], ids=range(7))
def test_long_texts_take_one_pass(text):
    secrets.lexed_spans(text)


def test_spans_of_the_query(spark):
    text = f'😀 k = "{S}"\napi_key = k\n'
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    at = text.index(S)
    assert (row.spans, row.n_lexed, row.base_sha256) == (f"lexed:{at}:{at + len(S)}", 1, hashlib.sha256(b"").hexdigest())
