from corpusatlas.functions import source

CODE = '''/* import no from 'commented';
import no2 from "commented2"; */
import def from 'one';
import { a, b as c } from "two";
import type { T } from '../three';
import {
  long,
  list
} from './four';
import 'side-effect';
import * as ns from 'five'
import eq = require('not-seen');
export { x } from 'not-seen-either';
const lazy = import('not-seen');
// import z from 'line-comment';

export default async function outer<T extends Map<string, number>>(
  a: Map<string, number>,
  cb: (x: number, y: string) => void,
  { b, c }: { b: string; c: number } = { b: 'x', c: 1 },
  ...rest: string[]
): Promise<void> {
  function inner(q: string) {
  }
}
function plain(x, y = 2) {
}
function* gen(): Generator {
}

@Component({
  selector: 'app-x',
  templateUrl: './x.html',
  styleUrls: ['./x.scss', "./y.css"],
})
@Other(1, 'two')
export abstract class X<T> extends Base implements Y {
  @Input() name: string;
  constructor(private readonly s: Service) {
    super();
  }
  get value(): string {
    return '';
  }
  @HostListener('window:resize', ['$event'])
  async onResize(event: Event, n?: number): Promise<void> {
    if (event) {
      call(1);
    }
    for (const a of b) {
    }
  }
  @Inline() inline(@Inject(TOKEN) private p: P): void {
  }
  protected static helper = () => {
  };
  abstract later(a: string): number;
}

@Injectable() export class Short {}
class Plain {
  run() {
  }
}

export interface I<T> extends J {
  readonly id: number;
  'quoted-name'?: string;
  fn: (a: string) => void;
  nested: { a: string; b: number };
  list: Array<Map<string, number>>;
  method(a: string): void;
}
interface One { x: number; y: string }
interface Empty {}
'''


def one(evaluate, function):
    return evaluate(function, [CODE])[0]


def test_imports(evaluate):
    assert one(evaluate, source.import_specifiers) == [
        "one", "two", "../three", "./four", "side-effect", "five",
    ]


def test_glob_is_no_comment(evaluate):
    code = "const g = 'src/**/*.ts';\nimport a from 'a';\n"
    assert evaluate(source.import_specifiers, [code])[0] == ["a"]


def test_functions(evaluate):
    found = one(evaluate, source.functions)
    assert [f.name for f in found] == ["outer", "plain", "gen"]
    outer = found[0]
    assert [(p.name, p.type) for p in outer.parameters] == [
        ("a", "Map<string, number>"),
        ("cb", "(x: number, y: string) => void"),
        ("{ b, c }", "{ b: string; c: number }"),
        ("rest", "string[]"),
    ]
    assert outer.returnType == "Promise<void>"
    assert [(p.name, p.type) for p in found[1].parameters] == [("x", None), ("y", None)]
    assert found[1].returnType is None
    assert found[2].returnType == "Generator" and found[2].parameters == []


def test_classes(evaluate):
    found = one(evaluate, source.classes)
    assert [c.name for c in found] == ["X", "Short", "Plain"]
    x = found[0]
    assert [(d.name, len(d.arguments)) for d in x.decorators] == [("Component", 1), ("Other", 2)]
    assert x.decorators[1].arguments == ["1", "'two'"]
    assert [m.name for m in x.methods] == ["onResize", "inline", "later"]
    resize, inline, later = x.methods
    assert [(p.name, p.type) for p in resize.parameters] == [("event", "Event"), ("n", "number")]
    assert resize.returnType == "Promise<void>"
    assert [(d.name, d.arguments) for d in resize.decorators] == [
        ("HostListener", ["'window:resize'", "['$event']"])
    ]
    assert [(p.name, p.type) for p in inline.parameters] == [("p", "P")]
    assert [d.name for d in inline.decorators] == ["Inline"]
    assert later.returnType == "number"
    assert [d.name for d in found[1].decorators] == ["Injectable"]
    assert [m.name for m in found[2].methods] == ["run"]


def test_assets(evaluate):
    assert one(evaluate, source.decorator_assets) == ["./x.html", "./x.scss", "./y.css"]
    # A missing trailing comma is not recognised, and lists must be on one line.
    code = "@Component({\n  templateUrl: './x.html'\n})\nclass A {}\n"
    assert evaluate(source.decorator_assets, [code])[0] == []


def test_interfaces(evaluate):
    found = one(evaluate, source.interfaces)
    assert [i.name for i in found] == ["I", "One", "Empty"]
    assert [(p.name, p.type) for p in found[0].properties] == [
        ("id", "number"),
        ("quoted-name", "string"),
        ("fn", "(a: string) => void"),
        ("nested", "{ a: string; b: number }"),
        ("list", "Array<Map<string, number>>"),
    ]
    assert [(p.name, p.type) for p in found[1].properties] == [("x", "number"), ("y", "string")]
    assert found[2].properties == []


def test_long_input_keeps_the_stack_flat(evaluate):
    many = ", ".join(f"p{i}: string" for i in range(5000))
    lines = "\n".join(f"@D{i}({i})" for i in range(5000))
    body = "\n".join("  x = 1;" for _ in range(50000))
    code = f"{lines}\nexport class A {{\n{body}\n}}\nfunction f({many}) {{\n}}\n"
    assert len(evaluate(source.functions, [code])[0][0].parameters) == 5000
    assert len(evaluate(source.classes, [code])[0][0].decorators) == 5000


def test_deep_decorator_arguments(evaluate):
    code = (
        "@Component({\n  templateUrl: './d.html',\n  animations: [trigger('x', [transition(':enter', "
        "[animate(1, style({ a: [1, [2, (3)]] }))])])],\n})\nexport class Deep {\n}\n"
    )
    assert evaluate(source.decorator_assets, [code])[0] == ["./d.html"]
    assert len(evaluate(source.classes, [code])[0][0].decorators[0].arguments) == 1
