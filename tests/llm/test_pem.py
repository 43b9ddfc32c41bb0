"""Whole private keys are found and masked."""

import pytest

from docmill.llm import secrets

BODY = "\n".join(["MIIEpAIBAAKCAQEA" + "aB3+/xYz09Qw" * 4] * 5 + ["Zm9vYmFy=="])
HEAD, FOOT = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"


@pytest.mark.parametrize(
    ("key", "after"),
    [
        (f"{HEAD}\n{BODY}\n{FOOT}", "\nSome more text."),
        (f"{HEAD}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n{BODY}\n{FOOT}", " and more"),
        (f"{HEAD}\r\n{BODY}".replace("\n", "\r\n").replace("\r\r", "\r"), "\r\nText after it."),
        (f"{HEAD}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n{BODY}", "\nText after it."),
        (f"{HEAD}\n{BODY}\n{FOOT}".replace("\n", "\\n"), '", "x": 1'),
        (f"{HEAD}\n{BODY}".replace("\n", "\\n"), '", "x": 1'),
        (f"{HEAD} {BODY}\n{FOOT}".replace("\n", " "), " and more"),
        (HEAD, " is how a key begins, with no key here."),
    ],
)
def test_span(key, after):
    ((found,),) = [[s for s in f if secrets.RULES[s[1]][0] == "pem"] for f in secrets.scan_segment([f"see {key}{after}"])]
    assert (found[0], found[2]) == (4, 4 + len(key))


def test_mask(spark):
    rows = [(1, f"a {HEAD}\n{BODY}\n{FOOT} b {HEAD}\n{BODY}\n{FOOT} c"), (2, f"{HEAD}\n{BODY}\n\nPlain words follow.")]
    out = dict(secrets.mask_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out[1] == "a [SECRET] b [SECRET] c"
    assert "MII" not in out[2] and "Zm9v" not in out[2] and out[2] == "[SECRET]\n\nPlain words follow."
