"""Small ontologies from text: `A1⊑A; R≡[∃p.A ⊓ B]; disj(A, B); p:prop(func); i=p⁻; m:M`, many of them in one knowledge base."""

from __future__ import annotations

import re

from ontoflow.schema import BOTTOM, TOP

TOKEN = re.compile(r"\s*(OneOf|[A-Za-z_]\w*|[∃∀⊓⊔¬⊤⊥().,\[\]])")


class Ontologies:
    """Rows for KB.of; names of different ontologies are apart, equal constructs are one."""

    def __init__(self):
        self.rows = {k: [] for k in ("is_a", "equivalent", "prop_is_a", "some", "only", "list_member", "types", "domain_range", "entity")}
        self.ids: dict = {}
        self.next, self.blank, self.anonymous = 1000, -1000, 0

    def named(self, space: str, name: str, kind: str | None = None) -> int:
        if name in ("⊤", "Thing"):
            return TOP
        if name == "⊥":
            return BOTTOM
        key = (space, name)
        if key not in self.ids:
            self.next += 1
            self.ids[key] = self.next
            self.rows["entity"].append((self.next, name))
        if kind and (self.ids[key], kind) not in self.rows["types"]:
            self.rows["types"].append((self.ids[key], kind))
        return self.ids[key]

    def construct(self, kind: str, *parts) -> int:
        key = (kind, tuple(sorted(set(parts[0]))) if kind in ("and", "or", "not") else parts)
        if kind in ("and", "or") and len(key[1]) == 1:
            return key[1][0]
        if key not in self.ids:
            self.blank -= 1
            self.ids[key] = self.blank
            if kind in ("some", "only"):
                self.rows[kind].append((self.blank, *parts))
            else:
                self.rows["list_member"] += [(kind, self.blank, o) for o in key[1]]
        return self.ids[key]

    def parse(self, space: str, text: str) -> int:
        tokens = TOKEN.findall(text.strip())

        def unit() -> int:
            t = tokens.pop(0)
            if t in "∃∀":
                p = self.named(space, tokens.pop(0))
                assert tokens.pop(0) == "."
                return self.construct("some" if t == "∃" else "only", p, unit())
            if t == "¬":
                return self.construct("not", [unit()])
            if t == "(":
                x = either()
                assert tokens.pop(0) == ")"
                return x
            if t == "OneOf":
                assert tokens.pop(0) == "(" and tokens.pop(0) == "["
                found = [self.named(space, tokens.pop(0))]
                while tokens.pop(0) == ",":
                    found.append(self.named(space, tokens.pop(0)))
                assert tokens.pop(0) == ")"
                return self.construct("or", found)
            return self.named(space, t, None if t in "⊤⊥" or (space, t) in self.ids else "Class")

        def both() -> int:
            found = [unit()]
            while tokens and tokens[0] == "⊓":
                tokens.pop(0)
                found.append(unit())
            return self.construct("and", found)

        def either() -> int:
            found = [both()]
            while tokens and tokens[0] == "⊔":
                tokens.pop(0)
                found.append(both())
            return self.construct("or", found)

        x = either()
        assert not tokens, (text, tokens)
        return x

    def add(self, space: str, axioms: str) -> None:
        for axiom in (a.strip() for a in axioms.split(";")):
            if m := re.fullmatch(r"(\w+):prop(\(func\))?", axiom):
                self.named(space, m[1], "ObjectProperty")
                if m[2]:
                    self.named(space, m[1], "FunctionalProperty")
            elif m := re.fullmatch(r"(\w+)=(\w+)⁻", axiom):
                self.rows["list_member"].append(("inverse", self.named(space, m[1]), self.named(space, m[2])))
            elif m := re.fullmatch(r"disj\((.*)\)", axiom):
                self.blank -= 1
                self.rows["list_member"] += [("disjoint", self.blank, self.named(space, x.strip())) for x in m[1].split(",")]
            elif m := re.fullmatch(r"(\w+):(\w+)", axiom):
                if m[1] == "_":
                    self.anonymous += 1
                person = self.named(space, m[1] if m[1] != "_" else f"_{self.anonymous}", "NamedIndividual")
                self.rows["is_a"].append((person, self.named(space, m[2])))
            elif m := re.fullmatch(r"(.+?)(⊑|≡)\[(.*)\]", axiom):
                s, depth, part, parts = self.parse(space, m[1]), 0, "", []
                for c in m[3] + ",":
                    depth += (c in "([") - (c in ")]")
                    if c == "," and not depth:
                        parts.append(part)
                        part = ""
                    else:
                        part += c
                self.rows["is_a" if m[2] == "⊑" else "equivalent"] += [(s, self.parse(space, x)) for x in parts]
            elif m := re.fullmatch(r"(\w+)⊑([\w,⊤]+)", axiom):
                for o in m[2].split(","):
                    if (space, o) in self.ids and (self.ids[space, o], "ObjectProperty") in self.rows["types"]:
                        self.rows["prop_is_a"].append((self.named(space, m[1], "ObjectProperty"), self.ids[space, o]))
                    else:
                        self.rows["is_a"].append((self.named(space, m[1], "Class"), self.named(space, o, "Class")))
            elif axiom:
                assert re.fullmatch(r"\w+", axiom), axiom
                self.named(space, axiom, "Class")
