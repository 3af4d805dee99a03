"""Readers of text trees and writers of reports."""
