"""Small source files in all languages, for the readers whose languages and frameworks the tables lack, and what they hold.

The expected rows were read over by hand against the texts; as SQL they are `VALUES`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.sources import code

SOURCES = {
    "s/a.c": "#include <x.h>\n#define MAX(a, b) ((a) > (b) ? (a) : (b))\n\n/* A point. */\nstruct point {\n  int x;\n  struct other *next;\n};\n\n// Adds both.\n// Never fails.\nstatic int add(const struct point *p, int n) {\n  if (p->x > 0) { return helper(p, \"}\"); }\n  return MAX(n, 1);\n}\n\nint declared(void);\n\nvoid run(void)\n{\n  add(0, 1);\n}\n",
    "s/b.cpp": "namespace geo {\n/// A shape.\nclass Shape : public Base<int>, private Other {\n public:\n  Shape(int n) : size_(n) {}\n  virtual ~Shape() {}\n  int area(std::vector<int, A> v, int k = 3) const override { return compute(v); }\n  void later();\n private:\n  int size_;\n};\ntemplate <typename T>\nT twice(T x) { return x + x; }\n}\nvoid geo::Shape::later() { auto p = new Shape(2); p->area({}, 1); }\n",
    "s/C.cs": "using System;\nnamespace Shop.Core\n{\n  /// <summary>Keeps orders.</summary>\n  [Serializable]\n  public class Orders : IStore, Base<Order>\n  {\n    private readonly Bus bus = new Bus();\n    public int Count { get; set; }\n    public async Task<int> Save(Order order, int tries = 2)\n    {\n      bus.Send(order);\n      return Check(order);\n    }\n    int Check(Order o) => o.Size();\n  }\n  public interface IStore { int Save(Order o, int tries); }\n  public enum Kind { A, B }\n}\n",
    "s/d.kt": "package shop.web\n\n/** Serves pages. */\ndata class Page(val id: Int, val name: String) : Base(), Shown {\n  fun render(out: Writer): String {\n    out.write(name)\n    return twice(id)\n  }\n}\n\nobject Registry\n\ninterface Shown {\n  fun show()\n}\n\nfun twice(n: Int) = n * 2\n\nfun String.shout(times: Int = 1): String {\n  return Page(1, this).render(w)\n}\n",
    "s/e.php": "<?php\nnamespace App\\Http;\n\n/**\n * Shows users.\n */\nclass UserController extends Controller implements Shown {\n  # keeps it\n  public function show(int $id, ?string $name = null): array {\n    $repo = new UserRepo();\n    $repo->find($id);\n    return $this->wrap([$id]);\n  }\n  private function wrap(array $x) { return array_map(fn($y) => $y, $x); }\n}\n\ntrait Loud { }\n\nfunction helper($a) { return strtoupper($a); }\n",
    "s/F.java": "package shop.pay;\n\nimport java.util.Map;\n\n/** Takes payments. */\n@Service\npublic abstract class Payments<T> extends Base<T> implements Store, Closeable {\n  private final Ledger ledger = new Ledger();\n\n  public Payments(Ledger l) { this.init(l); }\n\n  /** Pays at once. */\n  @Override\n  public Map<String, Integer> pay(Map<String, Integer> sums, final int... n) throws E {\n    ledger.book(sums);\n    String s = \"}\";\n    return new Sum(n).total();\n  }\n\n  abstract void later(int x);\n\n  enum Kind { A { void f() { } }, B }\n}\n\nrecord Pair(int a, int b) { }\n",
    "s/g.js": "import axios from 'axios'\n\n/** Loads rows. */\nexport class Loader extends Base {\n  #cache = /[{(]/g\n  constructor(a, { b, c } = {}) { super(a) }\n  async load(url) { return this.parse(await get(url)) }\n  static parse(x) { return x / 2 / 3 }\n}\n\n// Twice as much.\nexport const twice = (n) => n * 2;\nconst slow = async function (x) { return twice(x) };\nfunction* gen(a = `}`) { yield a }\n",
    "s/h.ts": "/** What is shown. */\nexport interface Shown<T> extends A, B<T> { show(x: T): void }\nexport type Id = string | number;\nenum Kind { A, B }\n\n@Injectable()\nexport class Users implements Shown<User> {\n  constructor(private readonly repo: Repo, n?: number) {}\n  // Finds one.\n  @Log('x')\n  public async find(id: Id, opts: { deep: boolean } = { deep: true }): Promise<User | null> {\n    const q = new Query<User>(id);\n    q.run();\n    return this.repo.get(id);\n  }\n  get size(): number { return 1 }\n}\nexport const make = <T,>(x: T): Users => { return new Users(x) };\n",
    "s/i.go": "package shop\n\nimport \"fmt\"\n\n// Store keeps things.\ntype Store struct {\n\tBase\n\tname string `json:\"}\"`\n\t*sync.Mutex\n}\n\ntype Reader interface {\n\tRead(n int) error\n}\n\n// Get finds one.\nfunc (s *Store) Get(ctx context.Context, ids ...int) (map[string]int, error) {\n\tb := Bucket{1}\n\tb.Fill(ids)\n\ts.lock()\n\treturn nil, fmt.Errorf(\"}\")\n}\n\nfunc Map[T any](xs []T, f func(T) T) interface{} {\n\treturn f(xs[0])\n}\n",
    "s/j.py": "import os.path as p\nfrom .m import K as L\n\n\nclass A(L, p.B):\n    \"\"\"Holds it.\"\"\"\n\n    @property\n    def f(self, x, *y, z=1, **w):\n        k = Thing()\n        k.go()\n        return self.g(p.join(x))\n\n    async def g(self):\n        def inner():\n            pass\n        return inner()\n",
}

ENDPOINTS = {
    "r/app.py": "from flask import Flask\n\n@app.route('/users/<int:id>', methods=['POST'])\ndef save(id):\n    # requests.get('http://no/comment')\n    requests.get('http://pay/charge/1')\n    producer.send('orders', b'')\n\n@router.get(f'/items/{item}')\nasync def item(item):\n    await client.put('/stock', json={})\n\n@app.task(name='mail.send')\ndef mail(): app.send_task('log.write')\n\n@shared_task\ndef sweep(): pass\n\nurlpatterns = [path('about/', about), re_path(r'^old/$', old)]\nTEXT = \"\"\"@app.route('/no')\"\"\"\n",
    "r/Api.java": "package a;\n\n@RestController\n@RequestMapping(\"/api\")\npublic class Api {\n  @GetMapping(\"/x/{id}\")\n  public String get(String id) { return rest.getForObject(\"http://h/y?z=1\", String.class); }\n\n  @PostMapping(value = {\"/a\", \"/b\"})\n  public void post() { kafkaTemplate.send(\"orders\", x); rabbitTemplate.convertAndSend(\"mail\", m); }\n\n  @RequestMapping(path = \"/old\", method = RequestMethod.DELETE)\n  public void old() { web.get().uri(\"/w/{n}\", n).retrieve(); map.put(\"key\", v); }\n\n  @KafkaListener(topics = {\"orders\"})\n  public void on(String m) { }\n\n  @RabbitListener(queues = \"mail\")\n  public void mail(String m) { rocketMQTemplate.syncSend(\"bill\", m); }\n}\n",
    "r/Res.java": "@Path(\"/res\")\npublic class Res {\n  @GET\n  @Path(\"/one/{id}\")\n  public String one() { return \"@Path('/no')\"; }\n\n  @POST\n  public void all() { }\n}\n\n@RocketMQMessageListener(topic = \"bill\", consumerGroup = \"g\")\nclass On { }\n",
    "r/cats.ts": "@Controller('cats')\nexport class Cats {\n  @Get(':id')\n  one(@Param('id') id: string) { return fetch('/z/', { method: 'PUT' }) }\n\n  @Post()\n  make() { return this.http.get('/food') }\n}\n",
    "r/srv.js": "import ax from 'axios'\nconst http2 = axios.create({})\nrouter.post('/w/:id', (req, res) => res.send(1))\nfunction load() {\n  http2.get(`/q/${id}`)\n  ax.delete('/d', {})\n  fetch('http://h:1/f')\n  cache.get('/not/a/route')\n}\n",
    "r/m.go": "package m\n\nfunc Serve(r *gin.Engine) {\n\tr.GET(\"/g/:id\", h)\n\tmux.HandleFunc(\"/plain\", h)\n\tmux.Handle(\"POST /named/{x}\", h)\n\tchi.Delete(\"/c\", h)\n}\n\nfunc Call() {\n\thttp.PostForm(\"http://h/form\", nil)\n\treq, _ := http.NewRequest(http.MethodPatch, \"http://h/p\", nil)\n\treq, _ = http.NewRequestWithContext(ctx, \"DELETE\", \"/n\", nil)\n\tw.WriteMessages(ctx, kafka.Message{Value: v, Topic: \"orders\"})\n}\n",
}


#: Read over by hand against the texts: (id, component_type, start_line, end_line, parameters, base_classes, doc).
COMPONENTS = [
    ('s/a.c::point', 'struct', 5, 8, None, None, 'A point.'),
    ('s/a.c::add', 'function', 12, 15, 'p,n', None, 'Adds both.'),
    ('s/a.c::run', 'function', 19, 22, '', None, None),
    ('s/b.cpp::geo', 'namespace', 1, 14, None, None, None),
    ('s/b.cpp::geo.Shape', 'class', 3, 11, None, 'Base,Other', 'A shape.'),
    ('s/b.cpp::geo.Shape.Shape', 'method', 5, 5, 'n', None, None),
    ('s/b.cpp::geo.Shape.~Shape', 'method', 6, 6, '', None, None),
    ('s/b.cpp::geo.Shape.area', 'method', 7, 7, 'v,k', None, None),
    ('s/b.cpp::geo.twice', 'function', 12, 13, 'x', None, None),
    ('s/b.cpp::geo.Shape.later', 'method', 15, 15, '', None, None),
    ('s/C.cs::Orders', 'class', 5, 16, None, 'IStore,Base', '<summary>Keeps orders.</summary>'),
    ('s/C.cs::Orders.Save', 'method', 10, 14, 'order,tries', None, None),
    ('s/C.cs::Orders.Check', 'method', 15, 15, 'o', None, None),
    ('s/C.cs::IStore', 'interface', 17, 17, None, None, None),
    ('s/C.cs::IStore.Save', 'method', 17, 17, 'o,tries', None, None),
    ('s/C.cs::Kind', 'enum', 18, 18, None, None, None),
    ('s/d.kt::Page', 'class', 4, 9, None, 'Base,Shown', 'Serves pages.'),
    ('s/d.kt::Page.render', 'method', 5, 8, 'out', None, None),
    ('s/d.kt::Registry', 'object', 11, 11, None, None, None),
    ('s/d.kt::Shown', 'interface', 13, 15, None, None, None),
    ('s/d.kt::Shown.show', 'method', 14, 14, '', None, None),
    ('s/d.kt::twice', 'function', 17, 17, 'n', None, None),
    ('s/d.kt::shout', 'function', 19, 21, 'times', None, None),
    ('s/e.php::UserController', 'class', 7, 15, None, 'Controller,Shown', 'Shows users.'),
    ('s/e.php::UserController.show', 'method', 9, 13, 'id,name', None, 'keeps it'),
    ('s/e.php::UserController.wrap', 'method', 14, 14, 'x', None, None),
    ('s/e.php::Loud', 'trait', 17, 17, None, None, None),
    ('s/e.php::helper', 'function', 19, 19, 'a', None, None),
    ('s/F.java::Payments', 'abstract class', 6, 23, None, 'Base,Store,Closeable', 'Takes payments.'),
    ('s/F.java::Payments.Payments', 'method', 10, 10, 'l', None, None),
    ('s/F.java::Payments.pay', 'method', 13, 18, 'sums,n', None, 'Pays at once.'),
    ('s/F.java::Payments.later', 'method', 20, 20, 'x', None, None),
    ('s/F.java::Payments.Kind', 'enum', 22, 22, None, None, None),
    ('s/F.java::Pair', 'record', 25, 25, None, None, None),
    ('s/g.js::Loader', 'class', 4, 9, None, 'Base', 'Loads rows.'),
    ('s/g.js::Loader.constructor', 'method', 6, 6, 'a', None, None),
    ('s/g.js::Loader.load', 'method', 7, 7, 'url', None, None),
    ('s/g.js::Loader.parse', 'method', 8, 8, 'x', None, None),
    ('s/g.js::twice', 'function', 12, 12, 'n', None, 'Twice as much.'),
    ('s/g.js::slow', 'function', 13, 13, 'x', None, None),
    ('s/g.js::gen', 'function', 14, 14, 'a', None, None),
    ('s/h.ts::Shown', 'interface', 2, 2, None, 'A,B', 'What is shown.'),
    ('s/h.ts::Id', 'type', 3, 3, None, None, None),
    ('s/h.ts::Kind', 'enum', 4, 4, None, None, None),
    ('s/h.ts::Users', 'class', 6, 17, None, 'Shown', None),
    ('s/h.ts::Users.constructor', 'method', 8, 8, 'repo,n', None, None),
    ('s/h.ts::Users.find', 'method', 10, 15, 'id,opts', None, 'Finds one.'),
    ('s/h.ts::Users.size', 'method', 16, 16, '', None, None),
    ('s/h.ts::make', 'function', 18, 18, 'x', None, None),
    ('s/i.go::Store', 'struct', 6, 10, None, 'Base,sync.Mutex', 'Store keeps things.'),
    ('s/i.go::Reader', 'interface', 12, 14, None, None, None),
    ('s/i.go::Store.Get', 'method', 17, 22, 'ctx,ids', None, 'Get finds one.'),
    ('s/i.go::Map', 'function', 24, 26, 'xs,f', None, None),
    ('s/j.py::A', 'class', 5, 17, None, 'L,p.B', 'Holds it.'),
    ('s/j.py::A.f', 'method', 8, 12, 'x,z,y,w', None, None),
    ('s/j.py::A.g', 'method', 14, 17, '', None, None),
    ('s/j.py::A.g.inner', 'function', 15, 16, '', None, None),
]
#: (caller, callee, call_line, kind)
CALLS = [
    ('s/a.c::add', 'helper', 13, 'calls'),
    ('s/a.c::add', 'MAX', 14, 'calls'),
    ('s/a.c::run', 'add', 21, 'calls'),
    ('s/b.cpp::geo.Shape', 'Base', 3, 'inherits'),
    ('s/b.cpp::geo.Shape', 'Other', 3, 'inherits'),
    ('s/b.cpp::geo.Shape.area', 'compute', 7, 'calls'),
    ('s/b.cpp::geo.Shape.later', 'Shape', 15, 'creates'),
    ('s/b.cpp::geo.Shape.later', 'Shape.area', 15, 'calls'),
    ('s/C.cs::Orders', 'IStore', 6, 'inherits'),
    ('s/C.cs::Orders', 'Base', 6, 'inherits'),
    ('s/C.cs::Orders.Save', 'Bus.Send', 12, 'calls'),
    ('s/C.cs::Orders.Save', 'Check', 13, 'calls'),
    ('s/C.cs::Orders.Check', 'Order.Size', 15, 'calls'),
    ('s/d.kt::Page', 'Base', 4, 'inherits'),
    ('s/d.kt::Page', 'Shown', 4, 'inherits'),
    ('s/d.kt::Page.render', 'Writer.write', 6, 'calls'),
    ('s/d.kt::Page.render', 'twice', 7, 'calls'),
    ('s/d.kt::shout', 'Page', 20, 'calls'),
    ('s/d.kt::shout', 'render', 20, 'calls'),
    ('s/e.php::UserController', 'Controller', 7, 'inherits'),
    ('s/e.php::UserController', 'Shown', 7, 'inherits'),
    ('s/e.php::UserController.show', 'UserRepo', 10, 'creates'),
    ('s/e.php::UserController.show', 'UserRepo.find', 11, 'calls'),
    ('s/e.php::UserController.show', 'UserController.wrap', 12, 'calls'),
    ('s/e.php::UserController.wrap', 'array_map', 14, 'calls'),
    ('s/e.php::helper', 'strtoupper', 19, 'calls'),
    ('s/F.java::Payments', 'Base', 7, 'inherits'),
    ('s/F.java::Payments', 'Store', 7, 'inherits'),
    ('s/F.java::Payments', 'Closeable', 7, 'inherits'),
    ('s/F.java::Payments.Payments', 'Payments.init', 10, 'calls'),
    ('s/F.java::Payments.pay', 'Ledger.book', 15, 'calls'),
    ('s/F.java::Payments.pay', 'Sum', 17, 'creates'),
    ('s/F.java::Payments.pay', 'total', 17, 'calls'),
    ('s/g.js::Loader', 'Base', 4, 'inherits'),
    ('s/g.js::Loader.load', 'Loader.parse', 7, 'calls'),
    ('s/g.js::Loader.load', 'get', 7, 'calls'),
    ('s/g.js::slow', 'twice', 13, 'calls'),
    ('s/h.ts::Shown', 'A', 2, 'inherits'),
    ('s/h.ts::Shown', 'B', 2, 'inherits'),
    ('s/h.ts::Users', 'Shown', 7, 'inherits'),
    ('s/h.ts::Users.find', 'Query', 12, 'creates'),
    ('s/h.ts::Users.find', 'Query.run', 13, 'calls'),
    ('s/h.ts::Users.find', 'Repo.get', 14, 'calls'),
    ('s/h.ts::make', 'Users', 18, 'creates'),
    ('s/i.go::Store', 'Base', 6, 'inherits'),
    ('s/i.go::Store', 'sync.Mutex', 6, 'inherits'),
    ('s/i.go::Store.Get', 'Bucket.Fill', 19, 'calls'),
    ('s/i.go::Store.Get', 'Store.lock', 20, 'calls'),
    ('s/i.go::Store.Get', 'fmt.Errorf', 21, 'calls'),
    ('s/i.go::Map', 'f', 25, 'calls'),
    ('s/j.py::A', '.m.K', 5, 'inherits'),
    ('s/j.py::A', 'p.B', 5, 'inherits'),
    ('s/j.py::A.f', 'Thing', 10, 'calls'),
    ('s/j.py::A.f', 'Thing.go', 11, 'calls'),
    ('s/j.py::A.f', 'A.g', 12, 'calls'),
    ('s/j.py::A.f', 'os.path.join', 12, 'calls'),
    ('s/j.py::A.g', 'inner', 17, 'calls'),
]
#: (route_key, role, component_id, line_number, framework)
ROUTES = [
    ('__route__GET__/api/x/{}', 'server', 'r/Api.java::Api.get', 6, 'spring'),
    ('__route__GET__/y', 'client', 'r/Api.java::Api.get', 7, 'resttemplate'),
    ('__mq__rabbitmq__mail', 'server', 'r/Api.java::Api.mail', 18, 'rabbitmq'),
    ('__mq__rocketmq__bill', 'client', 'r/Api.java::Api.mail', 19, 'rocketmq'),
    ('__route__DELETE__/api/old', 'server', 'r/Api.java::Api.old', 12, 'spring'),
    ('__route__GET__/w/{}', 'client', 'r/Api.java::Api.old', 13, 'webclient'),
    ('__mq__kafka__orders', 'server', 'r/Api.java::Api.on', 15, 'kafka'),
    ('__route__POST__/api/a', 'server', 'r/Api.java::Api.post', 9, 'spring'),
    ('__mq__kafka__orders', 'client', 'r/Api.java::Api.post', 10, 'kafka'),
    ('__mq__rabbitmq__mail', 'client', 'r/Api.java::Api.post', 10, 'rabbitmq'),
    ('__route__POST__/res', 'server', 'r/Res.java::Res.all', 7, 'jaxrs'),
    ('__route__GET__/res/one/{}', 'server', 'r/Res.java::Res.one', 4, 'jaxrs'),
    ('__mq__rocketmq__bill', 'server', 'r/Res.java::unknown', 11, 'rocketmq'),
    ('__route__GET__/items/{}', 'server', 'r/app.py::item', 9, 'fastapi'),
    ('__route__PUT__/stock', 'client', 'r/app.py::item', 11, 'requests'),
    ('__mq__celery__mail.send', 'server', 'r/app.py::mail', 13, 'celery'),
    ('__mq__celery__log.write', 'client', 'r/app.py::mail', 14, 'celery'),
    ('__route__POST__/users/{}', 'server', 'r/app.py::save', 3, 'flask'),
    ('__route__GET__/charge/1', 'client', 'r/app.py::save', 6, 'requests'),
    ('__mq__kafka__orders', 'client', 'r/app.py::save', 7, 'kafka'),
    ('__mq__celery__sweep', 'server', 'r/app.py::sweep', 16, 'celery'),
    ('__route__GET__/^old/$', 'server', 'r/app.py::unknown', 19, 'django'),
    ('__route__GET__/about', 'server', 'r/app.py::unknown', 19, 'django'),
    ('__route__POST__/cats', 'server', 'r/cats.ts::Cats.make', 6, 'nestjs'),
    ('__route__GET__/food', 'client', 'r/cats.ts::Cats.make', 7, 'axios'),
    ('__route__GET__/cats/{}', 'server', 'r/cats.ts::Cats.one', 3, 'nestjs'),
    ('__route__PUT__/z', 'client', 'r/cats.ts::Cats.one', 4, 'fetch'),
    ('__route__POST__/form', 'client', 'r/m.go::Call', 11, 'net/http'),
    ('__route__PATCH__/p', 'client', 'r/m.go::Call', 12, 'net/http'),
    ('__route__DELETE__/n', 'client', 'r/m.go::Call', 13, 'net/http'),
    ('__mq__kafka__orders', 'client', 'r/m.go::Call', 14, 'kafka'),
    ('__route__GET__/g/{}', 'server', 'r/m.go::Serve', 4, 'gin'),
    ('__route__GET__/plain', 'server', 'r/m.go::Serve', 5, 'net/http'),
    ('__route__POST__/named/{}', 'server', 'r/m.go::Serve', 6, 'net/http'),
    ('__route__DELETE__/c', 'server', 'r/m.go::Serve', 7, 'mux'),
    ('__route__GET__/q/{}', 'client', 'r/srv.js::load', 5, 'axios'),
    ('__route__DELETE__/d', 'client', 'r/srv.js::load', 6, 'axios'),
    ('__route__GET__/f', 'client', 'r/srv.js::load', 7, 'fetch'),
    ('__route__POST__/w/{}', 'server', 'r/srv.js::unknown', 3, 'express'),
]


def _files(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(p, t, p.split("/")[0]) for p, t in texts.items()], "relative_path string, file_text string, repo_name string")


def endpoint_files(spark: SparkSession) -> DataFrame:
    """The files with endpoints as a table of source files."""
    return _files(spark, ENDPOINTS)


def parsed(spark: SparkSession) -> DataFrame:
    """The components of the sample files."""
    return code.components(_files(spark, SOURCES))


def sample_components(spark: SparkSession, d: str) -> DataFrame:
    """What the readers find in one file of each language."""
    return parsed(spark).select("id", "component_type", "start_line", "end_line", F.array_join("parameters", ",").alias("parameters"), F.array_join("base_classes", ",").alias("base_classes"), F.split("docstring", "\n")[0].alias("doc"))


def sample_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls, creations and base classes of the same files."""
    return code.calls(_files(spark, SOURCES)).select("caller", "callee", "call_line", "kind")


def sample_routes(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints and topics of one file of each framework."""
    return code.routes(endpoint_files(spark)).select("route_key", "role", "component_id", "line_number", "framework")


QUERIES = {f.__name__: f for f in (sample_components, sample_calls, sample_routes)}


def _values(rows: list[tuple], names: str) -> str:
    quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({names})"


SQL = {
    "sample_components": _values(COMPONENTS, "id, component_type, start_line, end_line, parameters, base_classes, doc"),
    "sample_calls": _values(CALLS, "caller, callee, call_line, kind"),
    "sample_routes": _values(ROUTES, "route_key, role, component_id, line_number, framework"),
}
