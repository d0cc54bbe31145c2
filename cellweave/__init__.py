"""cellweave: partitioning of grids, graphs, trees and points as Spark queries."""
