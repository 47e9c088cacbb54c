"""Route matching on the worked example, and routes read from code."""

from loomline.operators import routes as r
from loomline.sources import code

COLS = "component_id string, repo_name string, role string, protocol string, method string, path string, route_key string, extra string"


def example(spark):
    base = [
        (1, "web", "client", "http", "GET", "/orders"), (2, "api", "server", "http", "GET", "/orders"), (3, "web", "client", "http", "GET", "/users/42"), (4, "api", "server", "http", "GET", "/users/{}"),
        (5, "web", "client", "http", "POST", "/users/42"), (6, "web", "client", "http", "GET", "/users/42/posts"), (7, "web", "client", "http", "GET", "/local/1"), (8, "web", "server", "http", "GET", "/local/1"),
        (9, "api", "server", "http", "GET", "/local/{}"), (10, "api", "client", "mq", None, "orders"), (11, "jobs", "server", "mq", None, "orders"),
    ]
    rows = [(f"c{i}", repo, role, p, m, path, f"{m or 'kafka'} {path}", "clash") for i, repo, role, p, m, path in base]
    return spark.createDataFrame(rows, COLS)


def test_example(spark, rows):
    routes = example(spark)
    links = r.match_routes(routes)
    assert rows(links, "client_component", "server_component", "route_key", "confidence") == [("c1", "c2", "GET /orders", 1.0), ("c10", "c11", "kafka orders", 1.0), ("c3", "c4", "GET /users/{}", 0.8)]
    assert rows(r.unmatched_routes(routes), "component_id") == [(f"c{i}",) for i in (5, 6, 7, 8, 9)]
    assert rows(r.links_of_method(links, "get"), "client_component") == [("c1",), ("c3",)]
    counts = r.link_counts(routes).unionByName(r.link_counts(routes, "mq"))
    assert rows(r.protocol_histogram(counts)) == [("http", 1), ("mq", 1)]
    assert links.where("client_repo = server_repo").count() == 0
    assert rows(r.service_pairs(counts), "client_repo", "server_repo", "n_calls") == [("api", "jobs", 1), ("web", "api", 1)]
    assert r.match_routes(routes.where("false")).count() == 0


CODE = {
    "api/app.py": "from flask import Flask\n@app.route('/users/<int:id>', methods=['POST'])\ndef save(id):\n    requests.get('http://pay/charge/1')\n    producer.send('orders', b'')\n\nclass A(Base):\n    def m(self, x, *y):\n        return self.n(x)\n",
    "api/C.java": "package a.b;\n@RequestMapping(\"/api\")\npublic class C extends D {\n  @GetMapping(\"/x/{id}\")\n  public String get(String id) { return rt.getForObject(\"http://h/y\"); }\n}\n",
    "api/s.ts": "export class S {\n  go(a: number): void { fetch('/z/' , {method: 'PUT'}); }\n}\nrouter.post('/w/:id', f);\n",
    "api/m.go": "package m\ntype T struct {\n}\nfunc (t *T) Run(a int) error {\n\tr.GET(\"/g\", h)\n\thelp(a)\n\treturn nil\n}\n",
    "api/bad.py": "def broken(:\n",
    "api/none.txt": "x",
}


def files(spark):
    rows = [(p, t, "api") for p, t in CODE.items()] + [("api/null.py", None, "api"), ("api/app.py", CODE["api/app.py"], "api")]
    return spark.createDataFrame(rows, "relative_path string, file_text string, repo_name string")


def test_code_routes(spark, rows):
    got = rows(code.routes(files(spark)), "route_key", "role")
    assert got == sorted([
        ("__route__POST__/users/{}", "server"), ("__route__GET__/charge/1", "client"), ("__mq__kafka__orders", "client"), ("__route__GET__/api/x/{}", "server"),
        ("__route__GET__/y", "client"), ("__route__PUT__/z", "client"), ("__route__POST__/w/{}", "server"), ("__route__GET__/g", "server"),
    ])


def test_code_components(spark, rows):
    c = code.components(files(spark))
    assert rows(c, "id", "component_type") == sorted([
        ("api/app.py::save", "function"), ("api/app.py::A", "class"), ("api/app.py::A.m", "method"), ("api/C.java::C", "class"), ("api/C.java::C.get", "method"),
        ("api/s.ts::S", "class"), ("api/s.ts::S.go", "method"), ("api/m.go::T", "struct"), ("api/m.go::T.Run", "method"),
    ])
    calls = rows(code.calls(files(spark)), "caller", "callee", "kind")
    assert ("api/app.py::A", "Base", "inherits") in calls and ("api/app.py::A.m", "A.n", "calls") in calls and ("api/m.go::T.Run", "help", "calls") in calls
