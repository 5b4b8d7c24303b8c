"""Suffix arrays by induced sorting, as a Spark SQL function on the JVM.

Induced sorting is sequential integer work over arrays, for which Python has no vector form. The kernel below is plain Java; Spark's own run-time compiler
(Janino, which compiles all generated code) turns it to bytes once per application, and ``addJar`` takes those to the executors. Executors that join later get it the same way.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_CLASS = "ledgerstone.SuffixKernel"
# For symbols of type SYMBOL: the bytes of a text, which stay a quarter of the size, and the names of the shorter texts.
_SORT = r"""  /** Suffix array of s[0..n), symbols from -o and below k - o, after Nong, Zhang and Chan (2009). The end of the text counts as smaller than every symbol. */
  public static int[] sort(SYMBOL[] s, int n, int k, int o) {
    int[] sa = new int[n];
    if (n < 2) return sa;
    // Classify: a suffix is smaller or larger than its right neighbour. The last one is larger than the empty suffix.
    boolean[] small = new boolean[n];
    int m = 0;
    for (int i = n - 2; i >= 0; i--) small[i] = s[i] < s[i + 1] || (s[i] == s[i + 1] && small[i + 1]);
    for (int i = 1; i < n; i++) if (small[i] && !small[i - 1]) m++;
    int[] start = new int[k + 1];
    for (int i = 0; i < n; i++) start[s[i] + o + 1]++;
    for (int c = 0; c < k; c++) start[c + 1] += start[c];
    int[] left = new int[m];
    int q = 0;
    for (int i = 1; i < n; i++) if (small[i] && !small[i - 1]) left[q++] = i;
    int[] at = new int[k];
    induce(s, n, k, o, sa, start, at, left, m);
    if (m > 1) {
      // Name the leftmost-smaller substrings in the order found; equal neighbours share a name.
      int[] name = new int[n];
      int[] order = new int[m];
      int found = 0;
      for (int i = 0; i < n; i++) { int p = sa[i]; if (p > 0 && small[p] && !small[p - 1]) order[found++] = p; }
      int names = 0;
      name[order[0]] = 0;
      for (int i = 1; i < m; i++) {
        if (!same(s, n, small, order[i - 1], order[i])) names++;
        name[order[i]] = names;
      }
      if (names + 1 < m) {
        int[] shorter = new int[m];
        for (int i = 0; i < m; i++) shorter[i] = name[left[i]];
        name = null;
        int[] sub = sort(shorter, m, names + 1, 0);
        for (int i = 0; i < m; i++) order[i] = left[sub[i]];
      }
      induce(s, n, k, o, sa, start, at, order, m);
    }
    return sa;
  }

  /** Leftmost-smaller substrings at a and b are equal in symbols and types. */
  private static boolean same(SYMBOL[] s, int n, boolean[] small, int a, int b) {
    for (int d = 0; ; d++) {
      if (a + d >= n || b + d >= n) return false;
      if (s[a + d] != s[b + d] || small[a + d] != small[b + d]) return false;
      if (d > 0) {
        boolean endA = small[a + d] && !small[a + d - 1], endB = small[b + d] && !small[b + d - 1];
        if (endA || endB) return endA && endB;
      }
    }
  }

  /**
   * From the order of the leftmost-smaller suffixes, that of all larger ones by a scan to the right, then of all smaller ones by a scan to the left. Where a suffix is
   * put down, the symbols on its left are at hand, so that its left neighbour's class is known: it is put down as itself if a scan of that class is
   * to put the neighbour down too, else as its complement. So a scan looks up symbols, far apart in memory, only for suffixes that it puts down. The first
   * scan complements what it passes: the neighbours it left are the second's.
   */
  private static void induce(SYMBOL[] s, int n, int k, int o, int[] sa, int[] start, int[] at, int[] order, int m) {
    java.util.Arrays.fill(sa, -1);
    System.arraycopy(start, 1, at, 0, k);
    for (int i = m - 1; i >= 0; i--) sa[--at[s[order[i]] + o]] = order[i]; // larger ones are on their left
    System.arraycopy(start, 0, at, 0, k);
    sa[at[s[n - 1] + o]++] = s[n - 2] >= s[n - 1] ? n - 1 : -n;
    for (int i = 0; i < n; i++) {
      int v = sa[i];
      sa[i] = ~v;
      if (v > 0) { int j = v - 1, c = s[j]; sa[at[c + o]++] = j > 0 && s[j - 1] >= c ? j : ~j; }
    }
    System.arraycopy(start, 1, at, 0, k);
    for (int i = n - 1; i >= 0; i--) {
      int v = sa[i];
      if (v > 0) { int j = v - 1, c = s[j]; sa[--at[c + o]] = j > 0 && s[j - 1] <= c ? j : ~j; }
      else if (v < 0) sa[i] = ~v;
    }
  }
"""
_SOURCE = r"""
package ledgerstone;

/** (text, ends, least) to a bit per byte: a string of least bytes starts there that also starts in an earlier document of the text. */
public class SuffixKernel implements org.apache.spark.sql.api.java.UDF3 {

""" + _SORT.replace("SYMBOL", "byte") + _SORT.replace("SYMBOL", "int") + r"""
  /** Common prefix of each suffix with the one before it in sa, by text position: it shrinks by at most one from a position to the next. */
  public static int[] permutedPrefixes(byte[] t, int[] sa) {
    int n = sa.length;
    int[] p = new int[n];
    if (n > 0) p[sa[0]] = -1;
    for (int i = 1; i < n; i++) p[sa[i]] = sa[i - 1];
    int l = 0;
    for (int i = 0; i < n; i++) {
      int j = p[i];
      if (j < 0) { l = 0; }
      else { int most = n - Math.max(i, j); while (l < most && t[i + l] == t[j + l]) l++; }
      p[i] = l;
      if (l > 0) l--;
    }
    return p;
  }

  public Object call(Object text, Object bounds, Object length) {
    byte[] t = (byte[]) text;
    int least = ((Integer) length).intValue(), n = t.length;
    java.nio.IntBuffer b = java.nio.ByteBuffer.wrap((byte[]) bounds).order(java.nio.ByteOrder.LITTLE_ENDIAN).asIntBuffer();
    int[] ends = new int[b.remaining()];
    b.get(ends);
    int[] sa = sort(t, n, 256, 128); // bytes in signed order: any order of symbols brings equal prefixes together
    int[] lcp = permutedPrefixes(t, sa);
    boolean[] deep = new boolean[n]; // a byte per place: the walk in suffix order reads it at random
    for (int i = 0; i < n; i++) deep[i] = lcp[i] >= least;
    int[] of = lcp; // from here on the document of each place
    for (int d = 0, p = 0; d < ends.length; d++) for (; p < ends[d]; p++) of[p] = d;
    byte[] gone = new byte[(n + 7) / 8];
    for (int i = 0; i < n; ) {
      int j = i + 1;
      while (j < n && deep[sa[j]]) j++;
      if (j - i > 1) {
        int first = Integer.MAX_VALUE;
        for (int x = i; x < j; x++) { int p = sa[x], d = of[p]; if (d < first && ends[d] - p >= least) first = d; }
        for (int x = i; x < j; x++) { int p = sa[x], d = of[p]; if (d > first && ends[d] - p >= least) gone[p >> 3] |= (byte) (128 >> (p & 7)); }
      }
      i = j;
    }
    return gone;
  }
}
"""
_ready: set[str] = set()


def register(spark: SparkSession) -> None:
    """Compile the kernel and make it known to this application; once."""
    sc = spark.sparkContext
    jvm = spark._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setTargetVersion(8)
    compiler.setSourceVersion(8)
    compiler.cook(_SOURCE)
    if sc.applicationId not in _ready:
        path = os.path.join(tempfile.mkdtemp(), "suffix-kernel.jar")  # the driver serves it to executors
        with zipfile.ZipFile(path, "w") as jar:
            for name, code in dict(compiler.getBytecodes()).items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(path)
        _ready.add(sc.applicationId)
    kernel = jvm.java.lang.Class.forName(_CLASS, True, compiler.getClassLoader()).newInstance()
    spark._jsparkSession.udf().register("suffix_repeats", kernel, jvm.org.apache.spark.sql.types.DataTypes.BinaryType)


def repeats(text: Column, ends: Column, least: int) -> Column:
    """Bitmap over the bytes of text: a string of ``least`` bytes within a document also starts in an earlier one. ends: little-endian uint32 ends of the documents."""
    return F.call_function("suffix_repeats", text, ends, F.lit(least))
