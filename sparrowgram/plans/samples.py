"""Invented source files, one of each language, with the signatures that they have by the rules of each language, written out."""

from __future__ import annotations

SAMPLES: dict[str, tuple[str, str]] = {
    "shop/Cart.java": (
        """package shop;

/** Holds what a buyer wants. */
public class Cart extends Basket implements Countable {
    private final List<Item> items;

    public Cart(List<Item> items) { this.items = items; }

    /** Adds one item. Then sorts. */
    public boolean add(Item item, int times) {
        return items.add(item);
    }

    protected static Map<String, Integer> counts() { return null; }

    private void check() {}
}

enum Size { S, M, L }
""",
        """class Cart  :4-17  # Holds what a buyer wants
  add(Item item, int times) → boolean  :10-10  # Adds one item
  counts() → Map<String, Integer>  :14-14
enum Size  :19-19""",
    ),
    "shop/Price.kt": (
        """package shop

class Price(val amount: Long) {
    fun plus(other: Price, round: Boolean = true): Price {
        return other
    }
    private fun hidden(): Int = 1
    override suspend fun load(id: String) {
    }
}

fun zero(): Price = Price(0)
""",
        """class Price  :3-10
  fun plus(other, round) → Price  :4-4
  suspend fun load(id)  :8-8
fun zero() → Price  :12-12""",
    ),
    "shop/Stock.cs": (
        """namespace Shop
{
    public class Stock : IStock
    {
        public async Task<int> CountAsync(string sku)
        {
            return 1;
        }
        internal static bool Has(string sku) { return true; }
        void Hidden() { }
    }
    public struct Shelf { }
}
""",
        """class Stock  :3-11
  CountAsync(string sku) → Task<int>  :5-5
  Has(string sku) → bool  :9-9
struct Shelf  :12-12""",
    ),
    "shop/Route.swift": (
        """public final class Route: Path {
    public static func make(from start: Int, to end: Int) -> Route? {
        return nil
    }
    private func hidden() {}
    mutating func clear() {
    }
}

func measure(_ r: Route) -> Double {
    return 1
}
""",
        """class Route  :1-8
  func make(from start, to end) → Route?  :2-2
  func clear()  :6-6
func measure(_ r) → Double  :10-12""",
    ),
    "shop/tree.rs": (
        """/// A tree of shelves.
pub struct Tree<T> {
    root: Option<T>,
}

impl<T> Tree<T> {
    pub fn push(&mut self, item: T) -> bool {
        true
    }
    fn hidden(&self) {}
}

pub async fn grow(by: usize) -> Result<Tree<u8>, std::io::Error> {
    todo!()
}
""",
        """pub struct Tree  :2-4  # A tree of shelves
impl Tree  :6-11
  pub fn push(&mut self, item: T) → bool  :7-7
pub async fn grow(by: usize) → Result<Tree<u8>, std::io::E...  :13-15""",
    ),
    "shop/Bill.scala": (
        """case class Line(name: String, cents: Long) {
  def total: Long = cents
}

object Bill {
  def of(lines: Seq[Line], tax: Double): Bill = {
    new Bill(lines)
  }
}

def show(b: Bill): String = b.toString
""",
        """case class Line  :1-3
  def total → Long  :2-2
object Bill  :5-9
  def of(lines, tax) → Bill  :6-6
def show(b) → String  :11-11""",
    ),
    "shop/queue.go": (
        """package shop

// Queue holds orders. It is a ring.
type Queue struct {
	size int
}

type Worker interface {
	Run(q *Queue) error
	Stop()
}

// Push adds an order.
func (q *Queue) Push(o Order) (int, error) {
	return 1, nil
}

func New(size int) *Queue {
	return &Queue{size: size}
}
""",
        """type Queue struct  :4-6  # Queue holds orders
type Worker interface  :8-11
  Run(q *Queue) → error  :9-9
  Stop()  :10-10
func (q) Push(o Order) → (int, error)  :14-16  # Push adds an order
func New(size int) → *Queue  :18-20""",
    ),
    "shop/Mail.php": (
        """<?php
abstract class Mail extends Letter
{
    public function __construct(array $to) {}
    public static function make(string $to, int $n = 1): self
    {
        return new self();
    }
    private function hidden() {}
}

function send(Mail $m): bool
{
    return true;
}
""",
        """class Mail  :2-10
  function make(string $to, int $n = 1) → self  :5-5
function send(Mail $m) → bool  :12-15""",
    ),
    "shop/page.dart": (
        """class Page extends Widget {
  final int n;
  Page(this.n);
  String title(int k) => 'x';
  Future<void> load(String url) async {
    await get(url);
  }
}

int twice(int x) => x * 2;
""",
        """class Page  :1-8
  title(int k) → String  :4-4
  load(String url) → Future<void>  :5-5
twice(int x) → int  :10-10""",
    ),
    "shop/grid.cpp": (
        """class Grid {
public:
    Grid(int w, int h);
    int at(int x, int y) const;
private:
    void hidden(int k);
};

int area(const Grid& g) {
    return 1;
}
""",
        """class Grid
  Grid(int w, int h)
  at(int x, int y) → int
area(const Grid& g) → int""",
    ),
    "shop/user.rb": (
        """class User < Person
  def name(first, last)
    first
  end

  def self.find(id)
    nil
  end

  def _hidden
  end
end
def greet(user)
  1
end
""",
        """class User
  def name(first, last)
  def self.find(id)
def greet(user)""",
    ),
    "shop/cart.js": (
        """class Cart extends Base {
  constructor(items) {
    this.items = items;
  }
  static async load(id, key) {
    return new Cart([]);
  }
  _hidden() {
  }
}

export function total(cart) {
  return 0;
}

export const empty = (cart) => !cart;

module.exports = { Cart, total };
""",
        """class Cart  :1-10
  constructor(items)  :2-4
  static async load(id, key)  :5-7
export function total(cart)  :12-14
export const empty = (cart) =>  :16-16
module.exports = { Cart, total }  :18-18""",
    ),
    "shop/cart.ts": (
        """export interface Row {
  readonly id: number;
  label: string;
  move(to: number, fast: boolean): void;
}

export type Rows = Row[];

export abstract class Table {
  constructor(private rows: Row[]) {
  }

  async fill(rows: Row[]): Promise<void> {
    return;
  }

  private hidden(): void {
  }
}

export function useRows(id: number) {
  const rows = [];
  return { rows, size: 0 };
}
""",
        """export interface Row  :1-5
  readonly id: number  :2-2
  label: string  :3-3
  move(to, fast)  :4-4
export type Rows  :7-7
export abstract class Table  :9-19
  constructor(private rows)  :10-11
  async fill(rows) → Promise<void>  :13-15
export function useRows(id) → { rows, size }  :21-24""",
    ),
    "shop/stock.py": (
        '''class Stock(Base):
    """Counts."""

    LIMIT = 10

    def __init__(self, items: list, *, deep=False):
        pass

    async def count(self, sku: str) -> int:
        return 1

    def _hidden(self):
        pass


@dataclass
class Item:
    name: str
    cents: int = 0


def total(items, tax: Optional[float] = None) -> Optional[int]:
    """Sums up the items. In cents."""
    return None


@router.get("/stock/{sku}")
async def show(sku):
    return sku
''',
        """class Stock(Base)  :1-13
  LIMIT = 10
  def __init__(items: list, *, deep)
  async def count(sku: str) → int
@dataclass Item(name, cents)  :17-19
def total(items, tax: float?) → int|None  :22-24  # Sums up the items
async def show(sku)  :28-29
GET /stock/{sku}  →  show()  :28-29""",
    ),
    "shop/stats.R": (
        """#' Mean of a window.
#' @param x numbers
smooth <- function(x, k = 3) {
  x
}
.hidden <- function(x) x
Pile <- R6::R6Class("Pile", public = list(
  add = function(x, n = 1) {
    x
  }
))
setClass("Dot", representation(x = "numeric"))
""",
        """Pile <- R6Class("Pile")
  add <- function(x, n = 1)
smooth <- function(x, k = 3)  # Mean of a window
setClass("Dot")""",
    ),
    "shop/card.vue": (
        """<script>
export default {
  name: 'PriceCard',
  props: {
    cents: Number,
  },
  methods: {
    async buy(n) {
      return n;
    },
  },
  emits: ['bought'],
};
</script>
""",
        """component PriceCard
prop cents
emits bought""",
    ),
    "shop/card.svelte": (
        """<script>
  let hidden;
  export let cents = 0;
  export let name;
  $: euros = cents / 100;
</script>
""",
        """export let cents
export let name
$: euros""",
    ),
    "shop/index.html": (
        """<html><head><title> Shop </title></head>
<body><form id="find" action="/find"></form><main id="list" data-view="grid"></main></body></html>
""",
        """title: Shop
form#find action="/find"
form#find
main#list
data-view: grid""",
    ),
    "shop/site.css": (
        """:root { --gap: 4px; }
$wide: 90rem;
@mixin boxed($pad: 1px) { padding: $pad; }
@function half($x) { @return $x / 2; }
.shop { color: red; }
.shop-card { color: blue; }
""",
        """var --gap
$var $wide
@mixin boxed($pad: 1px)
@function half($x)
.shop-card
.shop""",
    ),
    "shop/deploy.yml": (
        """name: deploy
services:
  web:
    image: shop
  db:
    image: store
jobs:
  ship:
    steps: []
""",
        """keys: [name, services, jobs]
job: ship
service: web
service: db""",
    ),
    "shop/run.sh": (
        """#!/bin/sh
# Starts the shop
export PORT=80
start() {
  true
}
_hidden() {
  true
}
main() {
  start
}
""",
        """# Starts the shop
function start()
function main()
main "$@"
export PORT""",
    ),
    "shop/buyer.gd": (
        """class_name Buyer
extends Node2D

signal paid(cents: int)
enum Mood { CALM, CROSS = 5 }
const LIMIT: int = 9
@export var cash: int = 3
var _hidden := 1

static func make(cash: int) -> Buyer:
	return null

class Purse:
	func open(fast):
		pass
""",
        """class Buyer(Node2D)
  signal paid(cents)
  enum Mood { CALM, CROSS }
  const LIMIT = 9
  @export var cash: int
  static func make(cash) → Buyer
class Purse
  func open(fast)""",
    ),
    "Dockerfile": ("FROM shop:1 AS base\nENV MODE=on\nEXPOSE 80 443\nCMD [\"run\"]\n", "FROM shop:1 AS base\nEXPOSE 80 443\nCMD [\"run\"]\nENV MODE"),
}

#: Files that import each other, and the edges that they have.
LINKED: list[tuple[str, str]] = [
    ("tsconfig.json", '{ // aliases\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["web/*"], "store": ["web/store/main"],}}}'),
    ("web/app.ts", "import {a} from './lib/a'\nimport b from '@/lib/b'\nimport s from 'store'\nimport r from 'react'\nexport * from 'web/lib/c'\nconst d = require('../tools/d')\n"),
    ("web/lib/a.ts", "import './b'\n"), ("web/lib/b.tsx", ""), ("web/lib/c/index.ts", ""), ("web/store/main.ts", ""), ("tools/d.js", ""),
    ("py/run.py", "from .deep import x\nfrom pkg.mod import y\nimport os\n"), ("py/deep/__init__.py", "from ..run import z\n"), ("py/pkg/mod.py", ""),
    ("go/main.go", 'package main\n\nimport (\n\t"fmt"\n\t"example.com/shop/store"\n)\n\nfunc main() {\n\thelp()\n\tOpen()\n}\n'), ("go/util.go", "package main\n\nfunc help() {\n}\n"), ("go/store/open.go", "package store\n\nfunc Open() {\n}\n"),
    ("rs/main.rs", "mod tree;\npub mod deep;\nuse std::fmt;\n"), ("rs/tree.rs", ""), ("rs/deep/mod.rs", ""),
    ("jvm/src/shop/Main.java", "package shop;\nimport shop.cart.Cart;\nimport java.util.List;\npublic class Main {\n    public void run() {\n        pay();\n    }\n}\n"), ("jvm/src/shop/Pay.java", "package shop;\nclass Pay {\n    public void pay() {\n    }\n}\n"), ("jvm/src/shop/cart/Cart.kt", "import shop.Main\n"),
    ("rb/a.rb", "require_relative 'lib/b'\nrequire 'json'\n"), ("rb/lib/b.rb", "require_relative '../a.rb'\n"),
    ("R/a.R", "source('b.R') # source('c.R')\nx <- shop::total(1)\n"), ("R/b.R", "total <- function(x) x\n"), ("R/c.R", "source(\"R/a.R\")\n"),
]
EDGES = [
    ("web/app.ts", "web/lib/a.ts"), ("web/app.ts", "web/lib/b.tsx"), ("web/app.ts", "web/store/main.ts"), ("web/app.ts", "web/lib/c/index.ts"), ("web/app.ts", "tools/d.js"), ("web/lib/a.ts", "web/lib/b.tsx"),
    ("py/run.py", "py/deep/__init__.py"), ("py/run.py", "py/pkg/mod.py"), ("py/deep/__init__.py", "py/run.py"), ("go/main.go", "go/store/open.go"), ("rs/main.rs", "rs/tree.rs"), ("rs/main.rs", "rs/deep/mod.rs"),
    ("jvm/src/shop/Main.java", "jvm/src/shop/cart/Cart.kt"), ("jvm/src/shop/cart/Cart.kt", "jvm/src/shop/Main.java"), ("rb/a.rb", "rb/lib/b.rb"), ("rb/lib/b.rb", "rb/a.rb"), ("R/a.R", "R/b.R"), ("R/c.R", "R/a.R"),
]
CALLS = [("go/main.go#main", "go/util.go#help"), ("go/main.go#main", "go/store/open.go#Open"), ("jvm/src/shop/Main.java#run", "jvm/src/shop/Pay.java#pay")]
