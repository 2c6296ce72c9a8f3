"""Where rows come from: Markdown trees and tables."""
