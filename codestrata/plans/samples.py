"""Small repositories of our own that hit every scan rule and manifest reader.

The tables have few manifests, and most scan rules never match in them. Queries over manifests and rules read the
``files`` table together with these, so that every rule and reader is compared with SQL on rows that exercise it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.session import table

PYTHON = '''import os, pickle, subprocess, yaml
password = "winter-garden-7"
cursor.execute(f"SELECT * FROM t WHERE id = {row}")
subprocess.call("ls " + folder)
state = pickle.loads(blob)
total = eval(text)
exec(text)
conf = yaml.load(stream)
safe = yaml.load(stream, Loader=yaml.SafeLoader)
both = yaml.load(a, Loader=yaml.SafeLoader); other = yaml.load(b)
DEBUG = True
'''
JAVASCRIPT = '''eval(text);
box.innerHTML = text;
document.write(text);
console.log(text); console.error(text);
debugger;
const api_key = "garden-winter-77";
alert(text);
with (box) { close(); }
'''
TYPESCRIPT = "// @ts-ignore\n" * 4 + "".join(f"let v{i}: any = w{i}!.x;\n" for i in range(12)) + "export class Box implements Lid {}\ninterface Lid { open(): void }\nenum Size { S, M }\ntype Pair = [number, number];\n"
JAVA = '''class Risky extends Base {
  ResultSet a(Statement s) { return s.Statement.executeQuery("SELECT a FROM t WHERE x = " + x + ""); }
  String password = "garden-winter";
  void b() { try { run(); } catch (Exception e) { } }
  void c() { System.out.println(1); e.printStackTrace(); Runtime.getRuntime().exec(cmd); }
  Object d() { return new ObjectInputStream(in).readObject(); }
  int e() { return new Random().nextInt(); }
  SecretKeySpec k = new SecretKeySpec("abcdefghijklmnop1234", "AES");
  DocumentBuilderFactory f = DocumentBuilderFactory.newInstance();
  File g(String n) { return new File(base + n); }
}
interface Door {}
enum Hue { RED }
'''
GO = '''package main
func a() { fmt.Sprintf("SELECT %s", x).Query() }
func b() { q := "SELECT a FROM t WHERE x = " + x + "" }
var secret = "garden-winter-9"
func c() { math/rand.Intn(3); fmt.Sprintf("DELETE %d", x).Exec() }
func d() { path.Join(base, "../x"); ioutil.TempFile("", "x") }
var client = http.Client{}
var conf = tls.Config{InsecureSkipVerify: true}
func e() { for i := 0; i < 3; i++ { defer f.Close() } }
type Box struct { a int }
type Lid interface { Open() }
func g() { go run(); c := make(chan int); _ = c }
'''
CPP = '''#include <cstdio>
class Box { virtual void open(); };
struct Lid { int a; };
template <class T> T pick(T a) { return a; }
namespace shop { }
void a(char *d) { strcpy(d, s); printf("%s", d); }
void b(Lid *p) { free(p); p->a = 1; }
void c() { Lid *q = malloc(8); q->a = 2; free(q); free(q); }
void d() { void *r = malloc(n * m); int x = rand(); }
const char *password = "garden-winter";
void e() { system(cmd + arg); popen(cmd, "r"); fopen("../x", "r"); MD5(x); }
const char *key = "abcdefghijklmnop1234";
'''

FILES: list[tuple[str, str, str | None]] = [
    ("s-rules", "src/risky.py", PYTHON),
    ("s-rules", "web/risky.js", JAVASCRIPT),
    ("s-rules", "web/risky.ts", TYPESCRIPT),
    ("s-rules", "java/Risky.java", JAVA),
    ("s-rules", "go/risky.go", GO),
    ("s-rules", "cpp/risky.cpp", CPP),
    ("s-py", "requirements.txt", "# pinned\nRequests==2.25.1\nflask>=2.0,<3 ; python_version > '3'\n-r other.txt\n\nnumpy\npandas[sql]~=1.3  # tables\n"),
    ("s-py", "requirements-dev.txt", "pytest==7.1.0\r\nblack!=21.0\r\n"),
    ("s-py", "setup.py", "from setuptools import setup\nsetup(name='x', install_requires=[\n    'click>=8.0',\n    \"rich==12.4.4\",\n    'attrs',\n])\n"),
    ("s-py", "pyproject.toml", '[project]\nname = "x"\ndependencies = [\n  "httpx>=0.23",\n  "Pydantic==1.10.2",\n]\n\n[project.optional-dependencies]\ntest = ["coverage==6.5"]\n'),
    ("s-poetry", "pyproject.toml", '[tool.poetry]\nname = "y"\n\n[tool.poetry.dependencies]\npython = "^3.10"\nDjango = "^4.1"\ncelery = {version = "5.2.7", extras = ["redis"]}\nlocal = {path = "../local"}\n\n[tool.poetry.group.dev.dependencies]\nmypy = ">=0.991"\n'),
    ("s-poetry", "poetry.lock", '[[package]]\nname = "Django"\nversion = "4.1.3"\n\n[[package]]\nname = "celery"\nversion = "5.2.7"\n'),
    ("s-pipenv", "Pipfile", '[packages]\nrequests = "*"\nsqlalchemy = {version = "==1.4.44"}\n\n[dev-packages]\nipython = ">=8"\n'),
    ("s-pipenv", "Dockerfile", "FROM debian\nRUN apt-get update && apt-get install -y curl git \\\n  && rm -rf /x\nRUN apk add --no-cache bash\n"),
    ("s-pipenv", "LICENSE", "MIT License\n"),
    ("s-npm", "package.json", '{"name": "shop", "license": "MIT", "repository": "git:shop", "dependencies": {"lodash": "4.17.20", "left-pad": "*", "axios": "^0.21.0"}, "devDependencies": {"jest": "latest", "lodash": "^4.17.21"}}'),
    ("s-npm", "tools/package.json", '{"name": "tools", "dependencies": {"event-stream": "3.3.6"}}'),
    ("s-npm", "broken/package.json", '{"name": "broken", "dependencies": {'),
    ("s-npm", "package-lock.json", '{"name": "shop", "packages": {"": {"name": "shop"}, "node_modules/lodash": {"version": "4.17.20"}, "node_modules/a/node_modules/lodash": {"version": "3.10.1"}}}'),
    ("s-java", "pom.xml", "<project><dependencies><dependency><artifactId>log4j</artifactId>\n <version>1.2.17</version></dependency><dependency><artifactId>own</artifactId><version>2.0-SNAPSHOT</version></dependency>"
     "<dependency><artifactId>struts2-core</artifactId><version>2.3.1</version></dependency></dependencies></project>"),
    ("s-java", "sub/pom.xml", "<project><dependencies><dependency><artifactId>plain</artifactId></dependency></dependencies></project>"),
    ("s-java", "old/pom.xml", "<project><artifactId>spring-boot-starter</artifactId><version>1.5.0</version></project>"),
    ("s-java", "build.gradle", "repositories { mavenCentral() }\ndependencies { implementation 'a:b' version '+.' }\n"),
    ("s-java", "app/build.gradle.kts", "repositories { mavenCentral(); maven(\"https://repo.maven.apache.org/maven2\") }\n"),
    ("s-java", "settings.gradle", "maven { url 'http://repo.example.org' }\n"),
    ("s-go", "go.mod", "module shop\n\nrequire a.org/b v1.2.3 // indirect\n\nreplace a.org/c => ./c\n"),
    ("s-go", "tool/go.mod", "module tool\nreplace a.org/d v1.0.0 => a.org/e v1.0.1\n"),
    ("s-go", "clean/go.mod", "module clean\nrequire a.org/f v0.1.0\n"),
    ("s-cpp", "CMakeLists.txt", "project(shop)\nadd_executable(shop a.cpp)\n"),
    ("s-cpp", "good/CMakeLists.txt", "cmake_minimum_required (VERSION 3.20)\nset(CMAKE_CXX_STANDARD 20)\nadd_compile_options(-Wall -fstack-protector-strong)\n"),
    ("s-cpp", "Makefile", "all:\n\tcc a.c\n"),
    ("s-cpp", "good/makefile", "CFLAGS = -Wall -D_FORTIFY_SOURCE=2\n"),
    ("s-nx", "nx.json", "{}"),
    ("s-nx", "workspace.json", '{"projects": {"a": {"root": "libs/a"}, "gone": {"root": "libs/gone"}}}'),
    ("s-nx", "libs/a/package.json", '{"name": "@nx/a", "dependencies": {"x": "1"}, "scripts": {"build": "tsc"}}'),
    ("s-turbo", "turbo.json", "{}"),
    ("s-turbo", "package.json", '{"name": "root", "license": "MIT", "repository": "r", "workspaces": ["apps/*", "libs/core"]}'),
    ("s-turbo", "apps/web/package.json", '{"name": "web", "dependencies": {"react": "18.2.0"}, "devDependencies": {"vite": "4.0.0"}, "scripts": {"dev": "vite", "build": "vite build"}}'),
    ("s-turbo", "apps/deep/er/package.json", '{"name": "too-deep"}'),
    ("s-turbo", "libs/core/package.json", "{broken"),
    ("s-bazel", "WORKSPACE", ""),
    ("s-lerna", "lerna.json", '{"packages": ["modules/*"]}'),
    ("s-lerna", "modules/one/package.json", '{"name": "one", "license": "ISC", "repository": "r"}'),
    ("s-pnpm", "pnpm-workspace.yaml", "packages:\n  - 'packages/*'\n  - \"extra\"\n"),
    ("s-pnpm", "packages/p/package.json", '{"name": "p", "devDependencies": {"q": "^1.0.0"}}'),
    ("s-pnpm", "extra/package.json", '{"dependencies": {"z": "next"}}'),
    ("s-yarn", "yarn.lock", "# yarn\n"),
    ("s-yarn", "package.json", '{"name": "y", "license": "MIT", "repository": "r", "workspaces": ["w/*"]}'),
    ("s-yarn", "w/b/package.json", '{"name": "b", "license": "MIT", "repository": "r"}'),
    ("s-generic", "services/api/v1/package.json", '{"name": "api", "license": "MIT", "repository": "r"}'),
    ("s-generic", "README.rst", "Shop\n====\n\nUsage: run it.\n"),
    ("s-generic", "src/tools.py", "from domain import rules\nfrom domain.rules.base import Rule\nimport infrastructure.db\nimport requests\n"),
]


def sample_files(spark: SparkSession) -> DataFrame:
    """The samples as ``file_id, repo, path, ord, content``; their ids are negative."""
    rows = [(-i, repo, path, i, text) for i, (repo, path, text) in enumerate(FILES, 1)]
    return spark.createDataFrame(rows, "file_id bigint, repo string, path string, ord bigint, content string")


def files_and_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files").select("file_id", "repo", "path", "ord", "content")
    return files.unionByName(sample_files(spark))


def quote(text: str | None) -> str:
    """A text as an SQL literal."""
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    """Rows of texts and numbers as an SQL VALUES list."""
    return "(VALUES " + ", ".join("(" + ", ".join(quote(x) if isinstance(x, str) or x is None else str(x) for x in r) + ")" for r in rows) + ")"


#: The same for SQL: ``x`` are all files.
X = (
    "x AS (SELECT file_id, repo, path, ord, content, regexp_extract(path, '[^/]*$') AS name FROM (SELECT file_id, repo, path, ord, content FROM files UNION ALL "
    f"SELECT * FROM {values((-i, r, p, i, t) for i, (r, p, t) in enumerate(FILES, 1))} AS t(file_id, repo, path, ord, content)))"
)
