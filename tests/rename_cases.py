"""Renaming cases: (name, source, flags, expected fragments, absent fragments)."""

RENAME_CASES = [
    ("params_and_locals", """class Rect {
  double half(double w, double h) {
    double product = w * h;
    return product / 2;
  }
}
""", {}, ["double half(double num1, double num2)", "double num3 = num1 * num2;", "return num3 / <NUM>;"], ["product"]),
    ("numbers_start_anew_per_method", """class Pick {
  long twice(long v) { long d = v + v; return d; }
  char low(char c, String s) { char head = s.charAt(0); return c < head ? c : head; }
}
""", {}, ["long twice(long num1) { long num2 = num1 + num1; return num2; }",
          "char low(char chr1, String str1) { char chr2 = str1.charAt(<NUM>); return chr1 < chr2 ? chr1 : chr2; }"], ["head"]),
    ("loops_in_loops", """class Grid {
  int cells(int rows, int cols) {
    int total = 0;
    for (int r = 0; r < rows; r++) {
      for (int k = cols; k > 0; k--) {
        int weight = r + k;
        total += weight;
      }
    }
    return total;
  }
}
""", {}, ["int cells(int num1, int num2)", "for (int num4 = <NUM>; num4 < num1; num4++)",
          "for (int num5 = num2; num5 > <NUM>; num5--)", "int num6 = num4 + num5;", "num3 += num6;", "return num3;"], ["weight"]),
    ("matrix_and_map", """class Mat {
  double[] row(double[][] m, int at, java.util.Map<String, Integer> names) {
    double[] line = m[at];
    java.util.Set<String> keys = names.keySet();
    return line;
  }
}
""", {}, ["row(double[][] num_arr1, int num1, java.util.Map<String, Integer> obj1)", "double[] num_arr2 = num_arr1[num1];",
          "java.util.Set<String> obj2 = obj1.keySet();", "return num_arr2;"], ["keys "]),
    ("bool_char_float", """class Gate {
  boolean open(boolean key, char code, float level) {
    boolean ok = key && level > 1.5f;
    char next = (char) (code + 1);
    return ok || next == code;
  }
}
""", {"mask_numbers": False}, ["open(boolean bool1, char chr1, float num1)", "boolean bool2 = bool1 && num1 > 1.5f;",
                               "char chr2 = (char) (chr1 + 1);", "return bool2 || chr2 == chr1;"], ["level"]),
    ("loop_over_array", """class Sum {
  int all(int[] parts) {
    int out = 0;
    for (int part : parts) out += part;
    return out;
  }
}
""", {"mask_numbers": False}, ["int all(int[] num_arr1)", "int num1 = 0;", "for (int num2 : num_arr1) num1 += num2;"], ["part"]),
    ("last_declaration_of_a_name_counts", """class Acc {
  long go(long seed) {
    long acc = seed;
    if (seed > 3) { long acc = seed * 2; use(acc); }
    return acc;
  }
  void mixed(int base) {
    { int step = base; use(step); }
    { String step = "s"; use(step); }
  }
}
""", {}, ["long num3 = num1;", "{ long num3 = num1 * <NUM>; use(num3); }", "return num3;",
          "{ int str1 = num1; use(str1); }", "{ String str1 = <STR>; use(str1); }"], ["acc", "num2"]),
    ("varargs", """class Max {
  int max(int first, int... rest) {
    int best = first;
    for (int r : rest) { if (r > best) best = r; }
    return best;
  }
}
""", {}, ["int max(int num1, int... obj1)", "for (int num3 : obj1) { if (num3 > num2) num2 = num3; }"], ["best", "rest"]),
    ("lambda_parameters_stay", """class Later {
  void plan(int delay) {
    Runnable job = () -> {
      int pause = delay * 2;
      sleep(pause);
    };
    submit(x -> x + delay, job);
  }
}
""", {}, ["void plan(int num1)", "Runnable obj1 = () -> {", "int num2 = num1 * <NUM>;", "sleep(num2);",
          "submit(x -> x + num1, obj1);"], ["pause"]),
    ("fields_stay", """class Cell {
  int count;
  String label;
  Cell(int count, String text) { this.count = count; label = text; }
  int next(int by) { return this.count + count + by; }
}
""", {"mask_numbers": False}, ["Cell(int num1, String str1) { this.count = num1; label = str1; }",
                               "int next(int num1) { return this.count + count + num1; }", "int count;"], []),
]

# (case, fragment, how often it occurs)
RENAME_COUNTS = [
    ("numbers_start_anew_per_method", "num2", 2),
    ("last_declaration_of_a_name_counts", "num3", 4),
    ("loops_in_loops", "num5", 4),
]

# Catch parameters and try resources are no declarations and stay as they are; a C-style array local keeps its element type.
EXTRA_CASES = [
    ("catch_and_resources",
     "class R {\n  void run(String path) {\n    try (java.io.Reader rd = open(path)) {\n      int n = rd.read();\n"
     "    } catch (Exception e) {\n      log(e);\n    }\n  }\n}\n",
     {"mask_numbers": False, "mask_strings": False},
     ["void run(String str1)", "java.io.Reader rd = open(str1)", "int num1 = rd.read();", "catch (Exception e)",
      "log(e);"], []),
    ("called_method_named_like_a_local",
     "class T {\n  String f(String s) {\n    String trim = s.trim();\n    return this.trim + trim;\n  }\n}\n",
     {"mask_numbers": False}, ["String str2 = str1.str2();", "return this.trim + str2;"], []),
    ("annotated_and_c_style_params",
     "class P {\n  int g(@Deprecated String name, int xs[], final long k, @SuppressWarnings(\"u\") String t) {\n"
     "    return xs.length + name.length() + (int) k + t.length();\n  }\n}\n",
     {"mask_numbers": False},
     ["int g(@Deprecated String str1, int num1[], final long num2, @SuppressWarnings(<STR>) String str2)",
      "return num1.length + str1.length() + (int) num2 + str2.length();"], []),
    ("abstract_and_interface_methods",
     "interface Cb {\n  void on(String event, int code);\n  java.util.List<String> all();\n}\n"
     "abstract class B {\n  abstract int size(int cap);\n  void run() { init(cap); go(1, 2); }\n}\n",
     {"mask_numbers": False}, ["void on(String str1, int num1);", "java.util.List<String> all();",
                               "abstract int size(int num1);", "void run() { init(cap); go(1, 2); }"], []),
    ("c_style_array",
     "class A {\n  void f() {\n    int vals[] = new int[3];\n    int k = vals[0];\n  }\n}\n",
     {"mask_numbers": False}, ["int num1[] = new int[3];", "int num2 = num1[0];"], []),
    ("locals_after_switch_labels",
     "class S {\n  int pick(int k) {\n    switch (k) {\n      case 1: int one = k; return one;\n      case A.B:\n        String two = \"x\";\n"
     "        return two.length();\n      default: long rest = 3; return (int) rest;\n    }\n  }\n"
     "  int arrow(int k) {\n    return switch (k) { case 1 -> { int one = k; yield one; } default -> { char c = 'a'; yield c; } };\n  }\n}\n",
     {"mask_numbers": False, "mask_strings": False},
     ["case 1: int num2 = num1; return num2;", "String str1 = \"x\";", "return str1.length();", "default: long num3 = 3; return (int) num3;",
      "case 1 -> { int num2 = num1; yield num2; }", "default -> { char chr1 = 'a'; yield chr1; }", "case A.B:"], ["one", "two", "rest"]),
    ("declarators_after_initialisers",
     "class D {\n  int go(int n) {\n    int[] q = {1, n}, r = {{2}, {n}}[0], s;\n    Runnable a = new Runnable() { int f = 1; public void run() { int g = n; } }, b = null;\n"
     "    Map<String, Integer> m = new HashMap<String, Integer>(), w = id(m, n), u;\n    int x = n < 2 ? 1 : 0, y = x;\n    b.run(); use(u, w, r, s);\n    return y;\n  }\n}\n",
     {"mask_numbers": False},
     ["int[] num_arr1 = {1, num1}, num_arr2 = {{2}, {num1}}[0], num_arr3;", "Runnable obj1 = new Runnable() { int f = 1; public void run() { int num2 = num1; } }, obj2 = null;",
      "Map<String, Integer> obj3 = new HashMap<String, Integer>(), obj4 = id(obj3, num1), obj5;",
      "int num3 = num1 < 2 ? 1 : 0, num4 = num3;", "obj2.run(); use(obj5, obj4, num_arr2, num_arr3);", "return num4;"], []),
    ("annotations_with_named_values",
     "class N {\n  int go(@B(min = 1, max = 2) int k, @a.b.C final String s) {\n    @A(x = 1) int z = k;\n    @A(x = 1, y = {2, 3}) List<String> l = of(s);\n"
     "    final @A(x = 2) Map<String, List<Integer>> m = to(l);\n    return z + m.size();\n  }\n}\n",
     {"mask_numbers": False},
     ["go(@B(min = 1, max = 2) int num1, @a.b.C final String str1)", "@A(x = 1) int num2 = num1;", "@A(x = 1, y = {2, 3}) List<String> obj1 = of(str1);",
      "final @A(x = 2) Map<String, List<Integer>> obj2 = to(obj1);", "return num2 + obj2.size();"], []),
    ("receivers",
     "class A {\n  int f(A this, int p) { return p + this.q; }\n  class B { B(A A.this, String s) { use(s); } }\n}\n", {},
     ["int f(A this, int num1) { return num1 + this.q; }", "B(A A.this, String str1) { use(str1); }"], []),
    ("text_blocks",
     "class T {\n  String f(int n) {\n    String s = \"\"\"\n      a \"quoted\" { ( n \\\"\"\" brace\n      \"\"\";\n    return s + n;\n  }\n}\n",
     {"mask_strings": False}, ["String f(int num1)", "String str1 = \"\"\"", "{ ( n \\\"\"\" brace", "return str1 + num1;"], []),
    ("lambda_bodies_and_calls",
     "class L {\n  void go(int n) {\n    run(new A(n) { int f = n; void in(int k) { use(k); } }, x -> { int d = x; return d; });\n    for (int i = 0, j = n; i < j; i++) { int d = i; use(d); }\n"
     "    int last = n;\n  }\n}\n",
     {"mask_numbers": False}, ["run(new A(num1) { int f = num1; void in(int num1) { use(num1); } }, x -> { int num5 = x; return num5; });",
                               "for (int num3 = 0, num4 = num1; num3 < num4; num3++) { int num5 = num3; use(num5); }", "int num6 = num1;"], []),
]

# Broken texts: (name, source, expected text).  A method is renamed where its own span is whole.
BROKEN_CASES = [
    ("one_brace_too_many", "void f(int p){ int q = p; use(q); } }", "void f(int num1){ int num2 = num1; use(num2); } }"),
    ("cut_in_a_head", "class A { void f(int p){ int q = p; } void g(", "class A { void f(int num1){ int num2 = num1; } void g("),
    ("cut_in_a_body", "class A { void f(int p){ int q = p; } void g(int z){ int y = z;", "class A { void f(int num1){ int num2 = num1; } void g(int z){ int y = z;"),
    ("begins_inside", "int y = z; } } void f(int p){ int q = p; } }", "int y = z; } } void f(int num1){ int num2 = num1; } }"),
    ("open_parenthesis", "class A { void f(int p){ use((p; } void g(int z){ use(z); } }", "class A { void f(int p){ use((p; } void g(int num1){ use(num1); } }"),
    ("extra_parenthesis", "class A { void f(int p){ use(p)); } void g(int z){ int y = z; } }", "class A { void f(int p){ use(p)); } void g(int num1){ int num2 = num1; } }"),
    ("crossed_brackets", "class A { void f(int p){ if (p > 0) { use(p; } ) } void g(int z){ use(z); } }", "class A { void f(int p){ if (p > 0) { use(p; } ) } void g(int num1){ use(num1); } }"),
    ("no_method_closes", "class A { void f(int p){ int q = p;", "class A { void f(int p){ int q = p;"),
]
