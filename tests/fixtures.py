"""Small corpora written for these tests: a telescope schedule, a seed
catalogue and a ferry timetable, with the constructs that need care."""

PY_APP = {
    "sky/plan.py": '''"""Plan observations.

Usage = example
class Fake:
def fake(): pass
"""
from .units import to_degrees
import os, json as js

QUERY = """
SELECT star
def not_code():
"""


def schedule(target, nights=(1, 2), *, site: dict[str, int] = None) -> list:
    # a comment ( with an open bracket
    return [to_degrees(n) for n in nights]


def rise(t): return t + 1  # one line


async def wait(
    seconds,
    label="): not the end",
):
    return seconds


class Dome(object):
    slit = 1

    def open(self):
        return QUERY


if os: mode = "x"
else: mode = "y"
limit: int = len([
3,
4])
''',
    "sky/units.py": '''def to_degrees(hours, minutes=0):
    """Hours ({[ to degrees."""
    return 15 * hours + minutes / 4


def to_hours(d):
    return d / 15


EPOCH = 2000
''',
}

JS_APP = {
    "seeds/catalog.js": """const { weigh } = require("./scale"), path = require('path');

function pack({
  kind,
  count = 12,
}) {
  return weigh(kind) * count;
}

const label = ({
  name,
}) => {
  return `${name} }) => {
function phantom() {`;
};

const twice = (f) => (x) => f(f(x));

function inline(a) { return a / 2; }

let rows = 3, beds = [4, 5], sow = (r, b) => r + b;

class Plot {
  #area = 4;

  // grow the ( plot
  async water(
    litres,
    { warm = false } = {},
  ) {
    if (warm) { return 1; }
    return litres;
  }

  static of(s = "}{") { return new Plot(); }
}

module.exports = { pack, label };
""",
    "seeds/scale.js": """/* function hidden() { */
function weigh(g) {
  return /[)}]/.test(g) ? 1 : Number(g);
}

const tare = function (g) {
  return g - 1;
};

module.exports = { weigh };
""",
}

TS_APP = {
    "ferry/board.ts": """import { Crossing, type Tide } from "./tables";

export function next(c: Crossing, at: { hour: number }): { port: string } {
  const t: Tide = c.tide;
  return { port: t + at.hour };
}

export const late = async (c: Crossing): Promise<number> => {
  return c.delay;
};

function quay(n: number): number {
  return n;
}
""",
    "ferry/tables.ts": """export interface Crossing {
  tide: Tide;
  delay: number;
}

export type Tide = "high" | "low";

export const enum Deck {
  Car,
  Foot,
}

export declare function tidal(at: number): Tide;
""",
}

# a cycle whose back edge is used: up.climb -> down.rest -> up.camp
CYCLE = {
    "hill/up.py": """from .down import rest


def climb():
    return rest()


def camp():
    return "tent"
""",
    "hill/down.py": """from .up import camp


def rest():
    return camp()
""",
}

# a diamond: the loaf asks two parents, both ask the mill
DIAMOND = {
    "bread/loaf.py": """from .dough import knead
from .crust import brown


def bake():
    return knead() + brown()
""",
    "bread/dough.py": """from .mill import flour


def knead():
    return flour()
""",
    "bread/crust.py": """from .mill import bran


def brown():
    return bran()
""",
    "bread/mill.py": """def flour():
    return 1


def bran():
    return 2


def husk():
    return 3
""",
}

JS_FORMS = {
    "map/view.js": """import Tiles from "./layer";
import { zoom as scale, pan } from "./layer";
import * as all from "./layer";
import "./map.css";

export class Sheet extends Paper {
  constructor(w) {
    this.w = w;
  }
  fold() {
    return scale(this.w) + pan;
  }
}

export { Sheet as Page };

export default function (q) {
  return Tiles(q) + all.grid;
}
""",
    "map/layer/index.js": """export function zoom(f) {
  return f;
}

export const pan = 2;
""",
}

DECORATED = {
    "oven/heat.py": """import contextlib


@contextlib.contextmanager
@retry(
    times=3,
)
def heated(degrees):
    yield degrees


PREHEAT: int = 180
""",
}

RUNS = [
    {"ts": "2031-03-04T06:30:00Z", "file": "ferry/board.ts",
     "baseline_tokens": 640, "pruned_tokens": 480, "tokens_saved": 160, "reduction_pct": 25.0},
    {"ts": "2031-03-04T19:05:00Z", "file": "sky/plan.py",
     "baseline_tokens": 1000, "pruned_tokens": 90, "tokens_saved": 910, "reduction_pct": 91.0},
    {"ts": "2031-03-06T00:00:00Z", "file": "ferry/board.ts",
     "baseline_tokens": 80, "pruned_tokens": 46, "tokens_saved": 34, "reduction_pct": 42.5},
    {"ts": "2031-03-05T12:00:00Z", "file": "seeds/scale.js",
     "baseline_tokens": 280, "pruned_tokens": 160, "tokens_saved": 120, "reduction_pct": 42.86},
]
