"""Small programs with the outcome of every call in them, for the call rules beyond their plainest form.

Each case is one or two files of a folder ({p} stands for its name) and one
outcome a call: found at the only line where the call is written.
"""

from __future__ import annotations

import re

NONE = (None, None, None, None)
STABLE, IMPORT, MODULE = "same_file_stable_binding", "internal_import_binding", "internal_module_attribute_binding"
OWN, OWN_IMPORTED = "same_file_class_attribute_binding", "internal_imported_class_attribute_binding"
ABOVE, ABOVE_IMPORTED = "same_file_inherited_class_attribute_binding", "internal_imported_inherited_class_attribute_binding"
MADE, MADE_ABOVE = "local_instance_constructor_binding", "local_instance_inherited_method_binding"

#: target, status, proof, shadowed_by, dynamic_kind, resolved
Outcome = tuple[str, str, str | None, str | None, str | None, str | None]
Case = tuple[list[tuple[str, str]], list[tuple]]


def proven(target: str, proof: str, resolved: str) -> Outcome:
    return target, "resolved_internal", proof, None, None, resolved


def potential(target: str) -> Outcome:
    return target, "potential_internal", *NONE


def unresolved(target: str) -> Outcome:
    return target, "unresolved", *NONE


def ambiguous(target: str) -> Outcome:
    return target, "ambiguous", *NONE


def shadowed(target: str, reason: str) -> Outcome:
    return target, "shadowed", None, reason, None, None


def dynamic(target: str, kind: str) -> Outcome:
    return target, "dynamic", None, None, kind, None


def case(source: str, *outcomes: Outcome, b: str | None = None) -> Case:
    """A case whose calls all stand in file a; ``b`` is the text of a second file."""
    lines, calls = source.split("\n"), []
    for target, *rest in outcomes:
        pattern = re.compile(rf"(?<![\w.])(?<!def )(?<!class ){re.escape(target)}\(")
        found = [k for k, line in enumerate(lines, 1) if pattern.search(line)]
        if len(found) != 1:
            raise ValueError(f"{target} is called on lines {found} of:\n{source}")
        calls.append(("a", found[0], target, *rest))
    return [("a", source), *([("b", b)] if b is not None else [])], calls


DEF, K, KM = "def f(): ...\n", "class K: pass\n", "class K:\n  def m(self): ...\n"
CALL, NEW, USE = "def g(): return f()\n", "def g(): return K()\n", "def g(): return K.m(None)\n"
WF = "def g(): return w.f()\n"
MAKE = "def g():\n  x = K()\n  {gap}return x.m()\n"

NAMES = [
    case(DEF + "import other as f\n" + CALL, potential("f")),
    case(DEF + "from other import *\n" + CALL, potential("f")),
    case("@wrap\n" + DEF + CALL, potential("f")),
    case("if on:\n  " + DEF + CALL, potential("f")),
    case("try: pass\nfinally:\n  " + DEF + CALL, potential("f")),
    case(DEF + "c = lambda f: f()\n", potential("f")),
    case(DEF + "c = [f() for f in fs]\n", potential("f")),
    case(DEF + "c = {k: f() for k, f in fs}\n", potential("f")),
    case("x = f()\n" + DEF, potential("f")),
    case("@f()\ndef g(): ...\n" + DEF, potential("f")),
    case("def g(v=f()): ...\n" + DEF, potential("f")),
    case(DEF + "for f in fs: pass\n" + CALL, potential("f")),
    case(DEF + "del f\n" + CALL, potential("f")),
    case(DEF + DEF + CALL, ambiguous("f")),
    case(DEF + "x = f()\n", proven("f", STABLE, "f")),
    case("async " + DEF + CALL, proven("f", STABLE, "f")),
    case(CALL + DEF, proven("f", STABLE, "f")),
    case(DEF + "def g():\n  global f\n  return f()\n", proven("f", STABLE, "f")),
    case("def g():\n  def f(): ...\n  return f()\n", shadowed("f", "assignment")),
    case("def g(): return print()\n", unresolved("print")),
    case("class A:\n  def f(self): ...\n" + CALL, unresolved("f")),
]

IMPORTS = [
    case("from .b import K as W\ndef g(): return W()\n", proven("W", IMPORT, "K"), b=K),
    case("from {p}.b import K\n" + NEW, proven("K", IMPORT, "K"), b=K),
    case("from .b import f\n" + CALL, proven("f", IMPORT, "f"), b=DEF),
    case("def g():\n  from .b import K\n  return K()\n", proven("K", IMPORT, "K"), b=K),
    case("from .b import K\nc = lambda K: K()\n", potential("K"), b=K),
    case("from .b import K\nc = [K() for K in ks]\n", potential("K"), b=K),
    case("from .b import K\nK = other\n" + NEW, potential("K"), b=K),
    case("def g():\n  x = K()\n  from .b import K\n  return x\n", potential("K"), b=K),
    case("@K()\ndef g(): ...\nfrom .b import K\n", potential("K"), b=K),
    case("def g(v=K()): ...\nfrom .b import K\n", potential("K"), b=K),
    case("from .b import J\ndef g(): return J()\n", unresolved("J"), b=K),
    case("from .nowhere import K\n" + NEW, unresolved("K"), b=K),
]

W = "import {p}.b as w\n"
MODULES = [
    case(W + "w = other\n" + WF, potential("w.f"), b=DEF),
    case(W + WF, potential("w.f"), b=DEF + "f = other\n"),
    case("def g():\n  v = w.f()\n  import {p}.b as w\n  return v\n", potential("w.f"), b=DEF),
    case("def g():\n  import {p}.b as w\n  return w.f()\n", proven("w.f", MODULE, "f"), b=DEF),
    case(W + 'setattr(w, "f", other)\n' + WF, unresolved("setattr"), potential("w.f"), b=DEF),
    case(W + "c = lambda w: w.f()\n", unresolved("w.f"), b=DEF),
    case(W + "c = [w.f() for w in ws]\n", unresolved("w.f"), b=DEF),
    case(W + "def g(w): return w.f()\n", shadowed("w.f", "parameter"), b=DEF),
    case(W + "def g():\n  w = other\n  return w.f()\n", shadowed("w.f", "assignment"), b=DEF),
    case(W + "def g(): return w.h()\n", unresolved("w.h"), b=DEF),
    case(W + "def g(): return w.K()\n", proven("w.K", MODULE, "K"), b=K),
    case(W + "def g(): return w.f.x()\n", unresolved("w.f.x"), b=DEF),
]

CLASSES = [
    case("class K:\n  async def m(self): ...\n" + USE, proven("K.m", OWN, "K.m")),
    case("from .b import K as W\ndef g(): return W.m(None)\n", proven("W.m", OWN_IMPORTED, "K.m"), b=KM),
    case("class K:\n  @staticmethod\n  def m(): ...\n" + USE, potential("K.m")),
    case(KM + "  m = other\n" + USE, potential("K.m")),
    case(KM + "K.m = other\n" + USE, potential("K.m")),
    case(KM + 'setattr(K, "m", other)\n' + USE, unresolved("setattr"), potential("K.m")),
    case("x = K.m(None)\n" + KM, potential("K.m")),
    case("from .b import K\n" + USE, potential("K.m"), b=KM + "K = other\n"),
    case("from .b import K\nK.m = other\n" + USE, potential("K.m"), b=KM),
    case('from .b import K as W\nsetattr(W, "m", other)\ndef g(): return W.m(None)\n', unresolved("setattr"), potential("W.m"), b=KM),
    case("class M(type):\n  def __getattribute__(cls, n): ...\nclass K(metaclass=M):\n  def m(self): ...\n" + USE, potential("K.m")),
    case(KM + "def g(K): return K.m(None)\n", shadowed("K.m", "parameter")),
    case(KM + "def g(): return K.n(None)\n", unresolved("K.n")),
    case("@wrap\n" + KM + USE, potential("K.m")),
    case("class K:\n  if on:\n    def m(self): ...\n" + USE, potential("K.m")),
]

PLAIN = proven("K", STABLE, "K")
INSTANCES = [
    case(KM + MAKE.format(gap="n = 10\n  s = 'ready'\n  pass\n  "), PLAIN, proven("x.m", MADE, "K.m")),
    case("from .b import K\n" + MAKE.format(gap=""), proven("K", IMPORT, "K"), proven("x.m", MADE, "K.m"), b=KM),
    case("from .b import K as W\n" + MAKE.format(gap="").replace("K()", "W()"), proven("W", IMPORT, "K"), proven("x.m", MADE, "K.m"), b=KM),
    case(KM + "class O:\n  def r(self):\n    x = K()\n    return x.m()\n", PLAIN, proven("x.m", MADE, "K.m")),
    case(KM + "class O:\n  def r(self):\n    x = K()\n    n = 1\n    return x.m()\n", PLAIN, proven("x.m", MADE, "K.m")),
    case("from .b import K\nclass O:\n  def r(self):\n    x = K()\n    return x.m()\n", proven("K", IMPORT, "K"), proven("x.m", MADE, "K.m"), b=KM),
    case(KM + "class O:\n  def r(self):\n    def s():\n      x = K()\n      return x.m()\n    return s()\n", PLAIN, unresolved("x.m"), shadowed("s", "assignment")),
    case("class K:\n  def m(self): ...\n  def r(self): return self.m()\n", unresolved("self.m")),
    *(case(KM + MAKE.format(gap=gap + "\n  "), PLAIN, unresolved("x.m")) for gap in ("x = other", "del x", "y = x", "if on: x = other")),
    case(KM + MAKE.format(gap="h()\n  "), PLAIN, unresolved("h"), unresolved("x.m")),
    case(KM + "def h(): return K()\ndef g():\n  x = h()\n  return x.m()\n", PLAIN, proven("h", STABLE, "h"), unresolved("x.m")),
    case(KM + MAKE.format(gap="").replace("g()", "g(x)"), PLAIN, unresolved("x.m")),
    case("class K:\n  def __init__(self): ...\n  def m(self): ...\n" + MAKE.format(gap=""), PLAIN, unresolved("x.m")),
    case("class K:\n  def __new__(cls): ...\n  def m(self): ...\n" + MAKE.format(gap=""), PLAIN, unresolved("x.m")),
    case("class K:\n  def __getattribute__(self, n): ...\n  def m(self): ...\n" + MAKE.format(gap=""), PLAIN, unresolved("x.m")),
    case(KM + "def g():\n  x = K()\n  return h() or x.m()\n", PLAIN, unresolved("h"), unresolved("x.m")),
    case(KM + "x = K()\nx.m()\n", PLAIN, unresolved("x.m")),
    case("def g(s): return s.m()\n", unresolved("s.m")),
]

SHADOWS = [
    case("from .b import K\ndef g():\n  K = None\n  return K()\n", shadowed("K", "assignment"), b=K),
    case(DEF + "def g():\n  import other as f\n  return f()\n", shadowed("f", "import")),
    case(DEF + "def o():\n  f = None\n  def g(): return f()\n", shadowed("f", "free")),
    case(DEF + "def o():\n  f = None\n  def g():\n    nonlocal f\n    return f()\n", shadowed("f", "nonlocal")),
    case(DEF + "def g(*f): return f()\n", shadowed("f", "parameter")),
    case(DEF + "def g():\n  for f in fs: pass\n  return f()\n", shadowed("f", "assignment")),
    case(DEF + "def g():\n  with x as f: return f()\n", shadowed("f", "assignment")),
    case(KM + "def g():\n  K = None\n  return K.m(None)\n", shadowed("K.m", "assignment")),
    case("def g(cb): return cb()\n", dynamic("cb", "callback_parameter")),
    case("def g(**cb): return cb()\n", dynamic("cb", "callback_parameter")),
]

Target = tuple[str, str] | str


def family(prefix: str, on_class: Target, on_instance: Target, *more: Outcome, b: str | None = None) -> Case:
    """A class W above which a method m may stand, called on the class and on a new instance."""
    made = []
    for name, given in (("W.m", on_class), ("w.m", on_instance)):
        made.append(proven(name, *given) if isinstance(given, tuple) else (name, given, *NONE))
    return case(prefix + "def c(): return W.m(None)\ndef i():\n  w = W()\n  return w.m()\n", made[0], proven("W", STABLE, "W"), made[1], *more, b=b)


NO, MAY = "unresolved", "potential_internal"
BM, BP = "class B:\n  def m(self): ...\n", "class B: pass\n"
WB = "class W(B): pass\n"
FROM = "from .b import B\n"
ONE_BASE = [
    family(BM + WB, (ABOVE, "B.m"), (MADE_ABOVE, "B.m")),
    family("class A:\n  def m(self): ...\nclass B(A): pass\n" + WB, (ABOVE, "A.m"), (MADE_ABOVE, "A.m")),
    family(BM + "class O: pass\nclass W(B, O): pass\n", (ABOVE, "B.m"), NO),
    family("class B:\n  @staticmethod\n  def m(): ...\n" + WB, NO, NO),
    family("class M(type): pass\n" + BM + "class W(B, metaclass=M): pass\n", NO, NO),
    family(BM + "class W(B):\n  m = other\n", NO, NO),
    family("class B:\n  def __init_subclass__(cls): ...\n  def m(self): ...\n" + WB, NO, NO),
    family(BM + "class O: pass\n" + WB + "W.__bases__ = (O,)\n", NO, NO),
    family("class A: pass\n" + BM + WB + "B.__bases__ = (A,)\n", NO, NO),
    family(BM + WB + "B.m = other\n", NO, NO),
    family(BM + WB + "B = other\n", NO, NO),
    family("class W(B): pass\n" + BM, NO, NO),
    family("class B(W):\n  pass\nclass W(B): pass\n", NO, NO),
]
IMPORTED_BASE = [
    family(FROM + WB, (ABOVE_IMPORTED, "B.m"), (MADE_ABOVE, "B.m"), b=BM),
    family("from .b import B as C\nclass W(C): pass\n", (ABOVE_IMPORTED, "B.m"), (MADE_ABOVE, "B.m"), b=BM),
    family(FROM + WB, (ABOVE_IMPORTED, "A.m"), (MADE_ABOVE, "A.m"), b="class A:\n  def m(self): ...\nclass B(A): pass\n"),
    family(WB + FROM, NO, NO, b=BM),
    family(FROM + "B = other\n" + WB, NO, NO, b=BM),
    family(FROM + "class O: pass\nclass W(B, O): pass\n", NO, NO, b=BM),
    family("from . import b\nclass W(b.B): pass\n", NO, NO, b=BM),
    family(FROM + WB, NO, NO, b="class B:\n  @staticmethod\n  def m(): ...\n"),
    family(FROM + WB, NO, NO, b="class M(type): pass\nclass B(metaclass=M):\n  def m(self): ...\n"),
    family(FROM + "class M(type): pass\nclass W(B, metaclass=M): pass\n", NO, NO, b=BM),
    family(FROM + "class W(B):\n  m = other\n", NO, NO, b=BM),
    family(FROM + "class O: pass\n" + WB + "W.__bases__ = (O,)\n", NO, NO, b=BM),
    family("from .b import B as C\nclass O: pass\nclass W(C): pass\nC.__bases__ = (O,)\n", NO, NO, b=BM),
    family(FROM + WB, NO, NO, b="class O: pass\n" + BM + "B.__bases__ = (O,)\n"),
    family("from .b import B as C\nclass W(C): pass\nC.m = other\n", NO, NO, b=BM),
    family(FROM + WB, NO, NO, b=BM + "B.m = other\n"),
    family(FROM + WB, NO, NO, b="class B:\n  def __init_subclass__(cls): ...\n  def m(self): ...\n"),
    family(FROM + "class W(B):\n  def __init__(self): ...\n", (ABOVE_IMPORTED, "B.m"), NO, b=BM),
    family(FROM + WB, (ABOVE_IMPORTED, "B.m"), NO, b="class B:\n  def __getattribute__(self, n): ...\n  def m(self): ...\n"),
    family("from .b import B as C\nclass W(C): pass\nC.__getattribute__ = other\n", (ABOVE_IMPORTED, "B.m"), NO, b=BM),
]

LM, LP = "class L:\n  def m(self): ...\n", "class L: pass\n"
RM, RP = "class R:\n  def m(self): ...\n", "class R: pass\n"
WLR = "class W(L, R): pass\n"
TWO_BASES = [
    family(LM + RP + WLR, (ABOVE, "L.m"), NO),
    family(LP + RM + WLR, (ABOVE, "R.m"), NO),
    family(LM + RM + WLR, (ABOVE, "L.m"), NO),
    family(LM + RM + "class W(R, L): pass\n", (ABOVE, "R.m"), NO),
    family(LP + RP + WLR, NO, NO),
    family("class L:\n  @staticmethod\n  def m(): ...\n" + RM + WLR, NO, NO),
    family(LM + "class R:\n  @staticmethod\n  def m(): ...\n" + WLR, NO, NO),
    family("class L:\n  m = other\n" + RM + WLR, NO, NO),
    family(LM + "class R:\n  m = other\n" + WLR, NO, NO),
    family(LM + "class R:\n  def __init_subclass__(cls): ...\n" + WLR, NO, NO),
    family(LM + RP + WLR + "R.m = other\n", NO, NO),
    family(LM + RP + WLR + "W.__bases__ = (R,)\n", NO, NO),
    family("class M(type): pass\n" + LM + RP + "class W(L, R, metaclass=M): pass\n", NO, NO),
    family(LM + RP + "class T: pass\nclass W(L, R, T): pass\n", NO, NO),
    family("class A: pass\nclass L(A):\n  def m(self): ...\n" + RP + WLR, (ABOVE, "L.m"), NO),
    family(LM + "class W(L, L): pass\n", NO, NO),
    family(LM + RP + WLR + "L = R\n", NO, NO),
]

AM, AP = "class A:\n  def m(self): ...\n", "class A: pass\n"
ZM, ZP = "class Z:\n  def m(self): ...\n", "class Z: pass\n"
LA, RZ = "class L(A): pass\n", "class R(Z): pass\n"
BRANCHES = [
    family(AM + LA + RP + WLR, (ABOVE, "A.m"), NO),
    family(LP + ZM + RZ + WLR, (ABOVE, "Z.m"), NO),
    family(AM + LA + ZM + RZ + WLR, (ABOVE, "A.m"), NO),
    family(AM + LA + ZM + RZ + "class W(R, L): pass\n", (ABOVE, "Z.m"), NO),
    family(AM + "class L(A):\n  def m(self): ...\n" + RP + WLR, (ABOVE, "L.m"), NO),
    family(AM + LA + RM + WLR, (ABOVE, "A.m"), NO),
    family(AP + LA + RM + WLR, (ABOVE, "R.m"), NO),
    family(LP + ZM + "class R(Z):\n  def m(self): ...\n" + WLR, (ABOVE, "R.m"), NO),
    family(AM + "class C(A): pass\nclass L(C): pass\n" + ZM + "class D(Z): pass\nclass R(D): pass\n" + WLR, (ABOVE, "A.m"), NO),
    family(AM + LA + "class R(A): pass\n" + WLR, NO, NO),
    family(AM + "class E: pass\nclass L(A, E): pass\n" + RP + WLR, NO, NO),
    family(AM + LA + RP + "class E: pass\nclass W(L, R, E): pass\n", NO, NO),
    family("class A:\n  @staticmethod\n  def m(): ...\n" + LA + RP + WLR, NO, NO),
    family(AM + LA + RP + WLR + "A.m = other\n", NO, NO),
    family("class O: pass\nclass A(O):\n  def m(self): ...\n" + LA + RP + WLR + "A.__bases__ = (R,)\n", NO, NO),
    family(AM + LA + RP + WLR + "L.__bases__ = (R,)\n", NO, NO),
    family(AM + LA + ZP + RZ + WLR + "Z.m = other\n", NO, NO),
    family(AM + LA + "class Z:\n  m = other\n" + RZ + WLR, NO, NO),
    family(AM + LA + "class Z:\n  def __init_subclass__(cls): ...\n" + RZ + WLR, NO, NO),
    family(AM + LA + RP + WLR + "A = R\n", NO, NO),
    family(AM + LA + RP + "class W(L, make()): pass\n", NO, NO, unresolved("make")),
    family(AP + LA + ZP + RZ + WLR, NO, NO),
]

OWNED = "class W(B):\n  def m(self): ...\n"
OWNERS = [
    family(BP + OWNED, (OWN, "W.m"), (MADE, "W.m")),
    family("class A: pass\nclass B(A): pass\n" + OWNED, (OWN, "W.m"), (MADE, "W.m")),
    family("class A: pass\nclass C(A): pass\nclass B(C): pass\n" + OWNED, (OWN, "W.m"), (MADE, "W.m")),
    family(BP + "class O: pass\nclass W(B, O):\n  def m(self): ...\n", MAY, NO),
    family(BP + "class W(B):\n  @staticmethod\n  def m(): ...\n", MAY, NO),
    family("class M(type): pass\n" + BP + "class W(B, metaclass=M):\n  def m(self): ...\n", MAY, NO),
    family("class B:\n  def __init_subclass__(cls): ...\n" + OWNED, MAY, NO),
    family(BP + "class O: pass\n" + OWNED + "W.__bases__ = (O,)\n", MAY, NO),
    family("class A: pass\n" + BP + OWNED + "B.__bases__ = (A,)\n", MAY, NO),
    family(BP + OWNED + "W.m = other\n", MAY, NO),
    family(BP + "class W(B):\n  def __init__(self): ...\n  def m(self): ...\n", (OWN, "W.m"), NO),
    family("class B:\n  def __getattribute__(self, n): ...\n" + OWNED, (OWN, "W.m"), NO),
]

CASES: list[Case] = NAMES + IMPORTS + MODULES + CLASSES + INSTANCES + SHADOWS + ONE_BASE + IMPORTED_BASE + TWO_BASES + BRANCHES + OWNERS
