"""Languages of paths: a static dimension and column expressions over it.

One line a language: name/category: suffixes in any case; suffixes in this very
case; file names in any case.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = """
abap/programming: .abap; ;
ada/programming: .adb .ada .ads; ;
assembly/programming: .asm .nasm; ;
basic/programming: .bas .basic; ;
batch/scripting: .bat .cmd; ;
blade/template: .blade.php; ;
c/programming: .c; ;
cairo/smart-contract: .cairo; ;
clojure/programming: .clj .cljs .cljc; ;
cmake/build: .cmake; ; CMakeLists.txt
cobol/programming: .cob .cbl .cobol; ;
cpp/programming: .cc .cp .cpp .cxx .c++ .hh .hpp .hxx .h++ .inl .ipp .tcc .tpp; .C;
csharp/programming: .cs .csx; ;
css/stylesheet: .css; ;
cue/configuration: .cue; ;
cypher/database: .cypher; ;
d/programming: .d; ;
dart/programming: .dart; ;
dhall/configuration: .dhall; ;
dockerfile/build: ; ; Dockerfile Containerfile
ejs/template: .ejs; ;
elixir/programming: .ex .exs; ;
elm/programming: .elm; ;
erb/template: .erb; ;
erlang/programming: .erl .hrl; ;
fish/scripting: .fish; ;
fortran/programming: .f .for .f77 .f90 .f95 .f03 .f08 .fpp; ;
fsharp/programming: .fs .fsi .fsx; ;
gleam/programming: .gleam; ;
glsl/shader: .glsl .vert .frag .geom .tesc .tese .comp; ;
go/programming: .go; ;
graphql/schema-query: .graphql .gql; ;
groovy/programming: .groovy .gvy .gy .gsh; ;
handlebars/template: .hbs .handlebars; ;
haskell/programming: .hs .lhs; ;
hcl/infrastructure: .hcl .tf .tfvars; ;
hlsl/shader: .hlsl .fx .fxh; ;
html/markup: .html .htm; ;
ini/configuration: .ini; ; .editorconfig
java/programming: .java; ;
javascript/programming: .js .jsx .mjs .cjs; ;
jinja/template: .jinja .jinja2 .j2; ;
json/data: .json; ;
jsonnet/configuration: .jsonnet .libsonnet; ;
julia/programming: .jl; ;
kotlin/programming: .kt .kts; ;
latex/documentation: .tex; ;
less/stylesheet: .less; ;
lua/scripting: .lua; ;
makefile/build: ; ; Makefile GNUmakefile
markdown/documentation: .md .markdown; ;
matlab/programming: ; ;
meson/build: ; ; meson.build meson_options.txt
move/smart-contract: .move; ;
nim/programming: .nim; ;
nix/infrastructure: .nix; ;
nushell/scripting: .nu; ;
objective_c/programming: ; ;
objective_cpp/programming: .mm; ;
ocaml/programming: .ml .mli; ;
pascal/programming: .pas .pascal .pp; ;
perl/scripting: .perl; ;
php/programming: .php .phtml; ;
plain_text/text: .txt; ; .gitignore DCO LICENSE
plpgsql/database: .pgsql; ;
plsql/database: .pls .plsql; ;
powershell/scripting: .ps1 .psm1 .psd1; ;
prisma/schema-query: .prisma; ;
protobuf/schema-query: .proto; ;
pug/template: .pug .jade; ;
python/programming: .py .pyi; ;
r/programming: .r; ;
restructured_text/documentation: .rst; ;
ruby/programming: .rb; ; Gemfile Rakefile
rust/programming: .rs; ;
sas/programming: .sas; ;
sass/stylesheet: .sass; ;
scala/programming: .scala .sc; ;
scss/stylesheet: .scss; ;
shell/scripting: .sh .bash .zsh; ; .bashrc .zshrc
solidity/smart-contract: ; ;
sparql/schema-query: .rq .sparql; ;
sql/database: .sql; ;
starlark/build: .bzl; ; BUILD BUILD.bazel WORKSPACE WORKSPACE.bazel
stata/programming: .do .ado; ;
svelte/markup: .svelte; ;
swift/programming: .swift; ;
systemverilog/hardware: .sv .svh; ;
tcl/scripting: .tcl; ;
thrift/schema-query: .thrift; ;
toml/configuration: .toml; ;
tsql/database: ; ;
twig/template: .twig; ;
typescript/programming: .d.ts .ts .tsx .mts .cts; ;
unknown/unknown: ; ;
verilog/hardware: ; ;
vhdl/hardware: .vhd .vhdl; ;
visual_basic/programming: .vb; ;
vue/markup: .vue; ;
vyper/smart-contract: .vy; ;
wgsl/shader: .wgsl; ;
xml/data: .xml; ;
yaml/configuration: .yaml .yml; ;
zig/programming: .zig; ;
"""

#: Fence labels that differ from the language's name.
FENCE_LABELS = dict(
    pair.split("=")
    for pair in "assembly=asm csharp=cs objective_c=objective-c objective_cpp=objective-cpp plain_text=text plpgsql=pgsql restructured_text=rst shell=bash unknown=text visual_basic=vbnet".split()
)
DISPLAY_NOTES = {"matlab": "its suffix is shared with another language, so no path is taken for it"}


@dataclass(frozen=True)
class Language:
    name: str
    category: str
    suffixes: tuple[str, ...]
    exact_suffixes: tuple[str, ...]
    basenames: tuple[str, ...]

    @property
    def recognised_by_path(self) -> bool:
        return bool(self.suffixes or self.exact_suffixes or self.basenames)


@cache
def languages() -> dict[str, Language]:
    out = {}
    for line in REGISTRY.strip().splitlines():
        head, rules = line.split(":", 1)
        folded, exact, names = ((part.split() for part in (rules.split(";") + ["", ""])[:3]))
        name, category = head.split("/")
        out[name] = Language(name, category, tuple(folded), tuple(exact), tuple(n.casefold() for n in names))
    return out


@cache
def rules() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """(file name, exact suffix, folded suffix) to language; a rule that two languages claim is an error."""
    tables: tuple[dict[str, str], dict[str, str], dict[str, str]] = ({}, {}, {})
    for language in languages().values():
        for table, keys in zip(tables, (language.basenames, language.exact_suffixes, language.suffixes), strict=True):
            for key in keys:
                if table.setdefault(key, language.name) != language.name:
                    raise ValueError(f"two languages claim {key}")
    return tables


def definition(name: str) -> Language:
    return languages()[name]


def fence_label_of(name: str) -> str:
    return FENCE_LABELS.get(name, name)


def dimension(spark: SparkSession) -> DataFrame:
    """language, category, kind (basename, exact, folded) and key, one row a rule; 104 languages at most."""
    parts = [
        f"('{lang.name}', '{lang.category}', '{kind}', '{key}')"
        for lang in languages().values()
        for kind, keys in (("basename", lang.basenames), ("exact", lang.exact_suffixes), ("folded", lang.suffixes))
        for key in keys or ()
    ]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(parts) + " AS t(language, category, kind, key)")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key] if table else F.lit(None)


@cache
def _fold_letters() -> tuple[str, str]:
    """Single letters whose case folding is not their lower case."""
    odd = [(chr(p), chr(p).casefold()) for p in range(128, 0x3000) if chr(p).casefold() != chr(p).lower() and len(chr(p).casefold()) == 1 and unicodedata.category(chr(p))[0] == "L"]
    return "".join(a for a, _ in odd), "".join(b for _, b in odd)


def folded(name: Column) -> Column:
    return F.lower(F.translate(name, *_fold_letters()))


def language_of(path: Column) -> Column:
    """Language of a path: file name first, then a suffix in its very case, then the longest folded suffix.

    A suffix starts at a dot, so its candidates are the at most few tails of the
    name that do; each is one probe of a constant map, longest tail first.  No
    join is needed, and the dimension never leaves the plan.
    """
    names, exact, suffixes = rules()
    name = F.element_at(F.split(path, "/"), -1)
    low = folded(name)

    def longest(table: dict[str, str], of: Column) -> Column:
        most = max(key.count(".") for key in table)
        tails = [F.when(F.size(F.split(of, "[.]")) > k, F.concat(F.lit("."), F.substring_index(of, ".", -k))) for k in range(most, 0, -1)]
        return F.coalesce(*[_lookup(table, t) for t in tails])

    return F.coalesce(_lookup(names, low), longest(exact, name), longest(suffixes, low), F.lit("unknown"))


def fence_label(language: Column) -> Column:
    return F.coalesce(_lookup(FENCE_LABELS, language), language)


def category_of(language: Column) -> Column:
    return _lookup({n: d.category for n, d in languages().items()}, language)
