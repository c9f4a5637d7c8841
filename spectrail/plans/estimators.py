"""Estimators: the monolithic fit, the block-wise pipeline, and maps that fuse other modalities with either."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BlockFit, Classifier, Fit, Fusion
from ..operators import absorption, clustering, composition, factorise, filters, fusion, measures, thickness
from ..operators.dictionary import Dictionary
from ..sources import blocks
from ..sources.blocks import corrected
from ..sources.results import read_results, write_results
from ..sources.shared import written


class _Maps:
    """What follows from G, W and H. names: G's columns; h: (pixel_id, h)."""

    def __init__(self, g: np.ndarray, names: Sequence[str] | None, table: DataFrame | None, background_rows: int) -> None:
        self.g, self.names, self.table, self.background_rows = np.asarray(g, float), names, table, background_rows
        self.w: np.ndarray | None = None
        self.h: DataFrame | None = None
        self.q: DataFrame | None = None
        self.refined: DataFrame | None = None
        self.costs: DataFrame | None = None

    def _rows(self, selected: Sequence[str] | None) -> list[tuple[int, str]]:
        names = self.names or [str(i) for i in range(self.g.shape[1])]
        return composition.simplex_rows(names[: self.g.shape[1] - self.background_rows], selected)

    def quantification(self, selected: Sequence[str] | None = None) -> DataFrame:
        """(pixel_id, q): atomic percent of the elements, or of the selected ones in their order."""
        own = self._rows(selected)
        self.q = self.h.select("pixel_id", composition.quantification(F.col("h"), self.w.tolist(), [i for i, _ in own]).alias("q"))
        return self.q

    def results(self) -> tuple[np.ndarray, DataFrame, DataFrame]:
        """Spectra (components x channels), loadings (pixel_id, h) and compositions (pixel_id, q)."""
        return (self.g @ self.w).T, self.h, self.quantification()

    def save(self, path: str, a: DataFrame | None = None) -> None:
        """Write G, W, H, the compositions and, if given, absorption factors (pixel_id, a) to a folder."""
        names = self.names or [str(i) for i in range(self.g.shape[1])]
        write_results(path, self.g, names, self.w, self.h, self.quantification(), a)

    def load(self, spark: SparkSession, path: str) -> DataFrame:
        """Take over G, W, H and the compositions of a folder."""
        found = read_results(spark, path)
        self.g, self.names, self.w, self.h, self.q = found.g, found.names, found.w, found.h, found.q
        return self.h

    def maps(self, q: DataFrame | None = None, elements: Sequence[str] | None = None) -> DataFrame:
        """(pixel_id, q, density, mean_z)"""
        own = elements or [e for _, e in self._rows(None)]
        return composition.with_maps(self.quantification() if q is None else q, "q", own, self.table)

    def thickness(self, lowloss: DataFrame, maps: DataFrame, zero_loss: float, scale: float, offset: float, beam: float, beta: float, alpha: float = 0.0, by: str = "density") -> DataFrame:
        """(pixel_id, thickness) from (pixel_id, spectrum) of low losses and the map `by`: density or mean_z."""
        if by not in ("density", "mean_z"):
            raise ValueError("by must be density or mean_z")
        rows = lowloss.join(maps.select("pixel_id", by), "pixel_id")
        return thickness.thickness_map(rows, "spectrum", zero_loss, scale, offset, beam, beta, alpha, **{by: by}).select("pixel_id", "thickness")

    def absorption(self, macs: DataFrame, energies: Sequence[float], elements: Sequence[str], take_off: float, thickness_map: DataFrame | None = None, thickness_nm: float | None = None, source: Fusion = Fusion.EELS) -> DataFrame:
        """(pixel_id, a). EELS: compositions of the fit and a thickness map; HAADF: refined ones and a map or a constant."""
        if (thickness_map is None) == (thickness_nm is None):
            raise ValueError("give exactly one of a thickness map and a constant")
        q = self.refined if Fusion(source) == Fusion.HAADF else self.quantification(elements)
        if q is None:
            raise ValueError("refine the compositions first")
        v = composition.element_values(self.table, elements)
        rows = q.join(thickness_map, "pixel_id") if thickness_map is not None else q.withColumn("thickness", F.lit(float(thickness_nm)))
        return absorption.correction_spectra(rows, "q", "thickness", absorption.coefficients(macs, elements, energies), v["atomic_mass"], v["density"], take_off)

    def refine(self, places: DataFrame, image: DataFrame, elements: Sequence[str], settings: fusion.Refinement = fusion.Refinement(), key: str | None = "block_id") -> DataFrame:
        """(key, pixel_id, q, image) refined by a dark-field image (pixel_id, image); key None takes one whole image, in tiles.

        places: (pixel_id, y, x and the key).
        """
        q = self.q if self.q is not None else self.quantification()
        fits = F.when(F.size("q") == len(elements), F.col("q")).otherwise(F.raise_error(F.lit("compositions and elements differ in number")))
        rows = q.withColumn("q", fits).join(places, "pixel_id").join(image, "pixel_id")
        numbers = composition.element_values(self.table, elements)["number"]
        if key is None:
            whole = [df.withColumn("block_id", F.lit(0)) for df in fusion.refine_image(rows, numbers, settings)]
            self.refined, self.costs = (df.select("block_id", *df.columns[:-1]) for df in whole)
        else:
            self.refined, self.costs = fusion.refine_groups(rows, numbers, settings, key)
        return self.refined

    def residual(self, pixels: DataFrame, count: int | None = None, by: str | None = None) -> DataFrame:
        return measures.residuals(pixels.join(self.h, "pixel_id"), (self.g @ self.w).tolist(), count, by)

    def report(self, selected: Sequence[str] | None = None) -> DataFrame:
        """(element, comp, at_percent, std_percent)"""
        spark = self.h.sparkSession
        names = list(self.names or [str(i) for i in range(self.g.shape[1])])
        g = spark.createDataFrame([(n, float(v)) for n, v in zip(names, self.g.sum(axis=0), strict=True)], "g_name string, value double")
        w = spark.createDataFrame([(n, k, float(v)) for n, row in zip(names, self.w, strict=True) for k, v in enumerate(row)], "g_name string, comp int, value double")
        hidden = names[len(names) - self.background_rows :] if self.background_rows else []
        return composition.concentration_report(composition.explained_intensity(g, w, self.h), hidden, selected)


class Unmixing(_Maps):
    """One fit over all pixels."""

    def __init__(self, g: np.ndarray, fit: Fit = Fit(), names: Sequence[str] | None = None, table: DataFrame | None = None, background_rows: int = 2) -> None:
        super().__init__(g, names, table, background_rows)
        self.fit, self.report_of_fit = fit, {}
        self.dictionary: Dictionary | None = None

    @classmethod
    def of(cls, dictionary: Dictionary, fit: Fit = Fit(), table: DataFrame | None = None) -> Unmixing:
        """An estimator of a dictionary from build()."""
        own = cls(dictionary.g, fit, list(dictionary.names), table, dictionary.background_rows)
        own.dictionary = dictionary
        return own

    def fit_transform(self, pixels: DataFrame, factors: DataFrame | None = None, w: np.ndarray | None = None, fixed_w: np.ndarray | None = None, h: DataFrame | None = None, fixed_h: DataFrame | None = None, refresh: int = 0, refresh_each_round: bool = False) -> DataFrame:
        """(pixel_id, h) of pixels(pixel_id, spectrum), which are divided by absorption factors (pixel_id, a) if given.

        h, fixed_h: (pixel_id, h) of a start, and of values that stay, where null and NaN are free. refresh: how often the
        background is made anew from the fit's mean composition, and the fit taken up again from there; 0 leaves G alone.
        refresh_each_round: it is also made anew after each step of W.
        """
        data = filters.non_negative(pixels if factors is None else corrected(pixels, factors))
        fit = self.fit
        if fit.simplex_w and fit.simplex_rows is None:
            fit = fit.change(simplex_rows=tuple(i for i, _ in self._rows(None)))
        if (refresh or refresh_each_round) and (self.dictionary is None or self.dictionary.refreshed is None):
            raise ValueError("only the background of a dictionary with internal absorption can be refreshed")

        def anew(now: np.ndarray) -> np.ndarray:
            self.dictionary = self.dictionary.refreshed(now)
            self.g = self.dictionary.g
            return self.g

        each = anew if refresh_each_round else None
        self.w, self.h, self.report_of_fit = factorise.fit_pixels(data, self.g, fit, w, fixed_w, h=h, fixed_h=fixed_h, refresh=each)
        for _ in range(refresh):
            self.dictionary = self.dictionary.refreshed(self.w)
            self.g = self.dictionary.g
            self.w, self.h, self.report_of_fit = factorise.fit_pixels(data, self.g, fit, self.w, fixed_w, h=self.h, fixed_h=fixed_h, refresh=each)
        return self.h


class BlockWiseUnmixing(_Maps):
    """Fits of blocks, whose pooled components are classified into common ones; then abundances of all pixels."""

    def __init__(self, g: np.ndarray, settings: BlockFit = BlockFit(), names: Sequence[str] | None = None, table: DataFrame | None = None, components: dict[int, int] | None = None, background_rows: int = 2) -> None:
        super().__init__(g, names, table, background_rows)
        self.settings, self.components = settings, components
        self.points: DataFrame | None = None
        self.clusters: DataFrame | None = None

    def prepare(self, pixels: DataFrame, image: tuple[int, int], block: tuple[int, int], path: str | None = None, factors: DataFrame | None = None) -> DataFrame:
        """pixels(pixel_id, spectrum) of a whole image (height, width), each place once, dealt into blocks (height, width), divided
        by absorption factors and normalised as settings say; written to path by blocks if given, and read from there."""
        rows = blocks.with_blocks(blocks.checked(pixels, *image), *block, image[1])
        rows = filters.non_negative(rows if factors is None else corrected(rows, factors))
        if self.settings.poisson:
            rows = measures.poisson_normalised(rows, by="block_id")
        if path is None:
            return rows
        blocks.write_blocks(rows, path)
        return blocks.read_blocks(rows.sparkSession, path, "spectrum")

    def pool(self, pixels: DataFrame) -> DataFrame:
        """(point_id, block_id, comp, features, background, w): the components of all blocks, post-processed."""
        s, own, n = self.settings, self.g.shape[1] - self.background_rows, self.g.shape[1]
        fit = s.fit if s.fit.simplex_rows is not None or not s.fit.simplex_w else s.fit.change(simplex_rows=tuple(i for i, _ in self._rows(None)))
        most = max([fit.components, *(self.components or {}).values()])
        rows = factorise.fit_blocks(pixels, self.g, fit, self.components)
        part = lambda first, count: F.slice("w", first, count) if count else F.array().cast("array<double>")
        parts = rows.select("block_id", "comp", part(1, own).alias("features"), part(own + 1, n - own).alias("background"))
        clean = filters.separate_blocks(parts, s.separation)
        point = F.col("block_id").cast("long") * most + F.col("comp")
        found = clean.select(point.alias("point_id"), "block_id", "comp", "features", "background", F.concat("features", "background").alias("w"))
        self.points = written(found, "points")  # an independent fit of each block stands behind it
        return self.points

    def classify(self) -> tuple[np.ndarray, dict[int, list[int]]]:
        """W of the common components, and which of them each block has: a list of small numbers for each block, which is all
        that comes here beside W."""
        s, floor = self.settings, self.settings.fit.floor
        if Classifier(s.classifier) in (Classifier.VCA, Classifier.REFINED_VCA):
            picked, ends = clustering.vca_points(self.points, s.clusters, s.seed)
            own = {r["point_id"]: r["background"] for r in self.points.where(F.col("point_id").isin(picked)).select("point_id", "background").collect()}
            w = np.vstack([ends, np.array([own[i] for i in picked]).T]) if self.background_rows else ends
            present = clustering.dominant_by_block(self.points, ends)
            return np.maximum(w, floor), {r["block_id"]: list(r["present"]) for r in present.collect()}
        self.clusters = written(clustering.spectral_clusters(self.points, s.clusters, s.sigma, s.metric, s.power, s.cluster_iter, s.cluster_tol, s.seed), "clusters")
        means = clustering.clustered_w(self.points, self.clusters, "w").orderBy("cluster").collect()
        order = {r["cluster"]: i for i, r in enumerate(means)}
        has = clustering.presences(self.points, self.clusters).groupBy("block_id").agg(F.array_sort(F.collect_list("cluster")).alias("present")).collect()
        return np.maximum(np.array([r["w"] for r in means]).T, floor), {r["block_id"]: [order[c] for c in r["present"]] for r in has}

    def fit_transform(self, pixels: DataFrame, factors: DataFrame | None = None, pooled: DataFrame | None = None, prepared: bool = False) -> DataFrame:
        """(pixel_id, h) of pixels(block_id, pixel_id, spectrum). pooled: components of an earlier run, as of pool(). prepared:
        pixels are of prepare(), which has corrected and normalised them."""
        data = filters.non_negative(pixels if factors is None else corrected(pixels, factors))
        s = self.settings
        if s.poisson and not prepared:
            data = measures.poisson_normalised(data, by="block_id")
        self.points = pooled if pooled is not None else self.pool(data)
        self.w, present = self.classify()
        if Classifier(s.classifier) in (Classifier.REFINED_SPECTRAL, Classifier.REFINED_VCA):
            self.w = factorise.refine_in_order(data, self.g, self.w, present, s.fit)
        if s.solve_by_svd:
            self.h = factorise.solve_fixed(data, self.g @ self.w, s.fit.simplex_h, s.fit.floor)
        else:
            self.h = factorise.abundances_by_block(data, self.g, self.w, s.fit).select("pixel_id", "h")
        return self.h

    def abundances(self, pixels: DataFrame, whole: bool = False) -> DataFrame:
        """(pixel_id, h) with W fixed by iteration: block by block, or over all pixels together."""
        fit = self.settings.fit.change(components=self.w.shape[1])
        if whole:
            _, self.h, _ = factorise.fit_pixels(pixels, self.g, replace(fit), self.w, update_w=False)
        else:
            self.h = factorise.abundances_by_block(pixels, self.g, self.w, fit).select("pixel_id", "h")
        return self.h
