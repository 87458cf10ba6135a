"""Commands to try a repository and the ladder of support."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import catalogue, support

CARGO = {"manifest": {"path": "Cargo.toml", "text": "[workspace]\nname = 'no'\n[package] # x\r\nversion = '1'\nname = \"my_tool\"\n[lib]\nname = 'other'\n"}}
PYTHON = {"manifest": {"path": "pyproject.toml", "text": "[build-system]\nname = 'no'\n[tool.poetry]\nname = 'My.Tool'\n"}}
GO = {"manifest": {"path": "go.mod", "text": "// x\nmodule github.com/octo/tool/v2\n"}}
NPM = {"packageJson": {"name": "@octo/tool", "scripts": ["dev", "test", "lint", "prepare", "start"]}}
#: Lines of code, facts, and the command that is shown.
CASES = [
    (["npm i -g @octo/tool"], NPM, "npm install -g @octo/tool"), (["$ sudo npm install @octo/tool@latest # now"], NPM, "npm install @octo/tool"), (["npm install other", "npm add -D @octo/tool"], NPM, None), (["npm i @octo/tool x"], NPM, None), (["npm i tool"], {}, None),
    (["npm test", "npm run lint", "npm run prepare", "npm run missing", "npm run dev -- --port 3000"], NPM, "npm run dev"), (["npm start"], NPM, "npm start"), (["npm start"], {"packageJson": {"scripts": ["dev"]}}, None), (["npm run -s dev"], NPM, None), (["cd x && npm run dev"], NPM, "npm run dev"),
    (["cargo install my-tool --locked"], CARGO, "cargo install my-tool --locked"), (["cargo install --git x my-tool"], CARGO, None), (["cargo install other"], CARGO, None), (["cargo install my_tool"], {"manifest": {"path": "x/Cargo.toml", "text": CARGO["manifest"]["text"]}}, None),
    (["pip install my-tool"], PYTHON, "pip install my-tool"), (["python3 -m pip install -U 'my_tool[all]>=1.0'"], PYTHON, "pip install my_tool"), (["pipx install My.Tool"], PYTHON, "pipx install My.Tool"), (["pip install -r requirements.txt"], PYTHON, None), (["pip install my-tool; rm -rf /"], PYTHON, "pip install my-tool"),
    (["go install github.com/Octo/tool/v2/cmd/x@latest"], GO, "go install github.com/Octo/tool/v2/cmd/x@latest"), (["go install github.com/octo/tool/cmd/x@v1.2"], GO, None), (["go install github.com/octo/tool@v1.2.3"], {}, "go install github.com/octo/tool@v1.2.3"), (["go install github.com/octo/toolbox@latest"], {}, None), (["go install github.com/octo/tool/../../x@latest"], {}, None), (["go install github.com/octo/tool"], {}, None),
    (["# npm start", "// npm start", ""], NPM, None),
]


def rows(spark, facts):
    lines = [(i, json.dumps({"nwo": "octo/tool"} | f)) for i, f in enumerate(facts)]
    return spark.createDataFrame(lines, "at int, line string").select("at", F.from_json("line", catalogue.FACTS).alias("f")).select("at", "f.*")


def test_commands_check_out(spark):
    facts = [f | {"readme": {"name": "R", "text": "words npm start\n```sh\n" + "\n".join(code) + "\n```\n"}} for code, f, _ in CASES] + [NPM | {"readme": {"text": "Install with `npm i @octo/tool` today"}}, NPM | {"nwo": "octo/..", "readme": {"text": "`npm start`"}}, NPM]
    found = rows(spark, facts).select("at", support.install_command(F.col("nwo"), F.col("readme.text"), F.col("packageJson"), F.col("manifest"))["command"].alias("c")).orderBy("at").collect()
    wrong = [(c[0], c[2], r["c"]) for c, r in zip(CASES, found) if c[2] != r["c"]]
    assert not wrong and [r["c"] for r in found[len(CASES) :]] == ["npm install @octo/tool", None, None]


def test_rungs_in_order(spark):
    full = NPM | {"readme": {"text": "`npm start`"}, "homepageUrl": "https://demo.x/y", "tags": 2, "hasIssues": True, "hasDiscussions": True, "funding": ["javascript:x", "https://patreon.com/z", "https://github.com/sponsors/q"]}
    few = {"homepageUrl": "javascript:x", "hasIssues": True, "ownerInfo": {"sponsorsListing": True}}
    found = {r["at"]: [(x["kind"], x["url"] or x["command"]) for x in r["l"]] for r in rows(spark, [full, few, {"nwo": "no name"}, {}]).select("at", support.ladder(F.lit("https://p.q/gem")).alias("l")).collect()}
    home = "https://github.com/octo/tool"
    assert found[0] == [("try", "npm start"), ("demo", "https://demo.x/y"), ("star", home), ("releases", home + "/releases.atom"), ("feedback", home + "/discussions"), ("share", "https://p.q/gem"), ("sponsor", "https://github.com/sponsors/q")]
    assert found[1] == [("star", home), ("feedback", home + "/issues"), ("share", "https://p.q/gem"), ("sponsor", "https://github.com/sponsors/octo")] and found[2] == [] and found[3] == [("star", home), ("share", "https://p.q/gem")]


@pytest.mark.parametrize("text,want", [("[project]\nname='a'", "a"), ("[project]\nx=1\n[other]\nname='a'", None), ("name='a'", None), (None, None), ('[ project ] # c\n  name = "b"\n', "b")])
def test_toml(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(support.toml_name(F.col("t"), ["project"])).first()[0] == want
